"""Readers and writers: delimited text with its headers, Parquet, name lists, configurations and statistics."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.config import Project
from tabforge.functions.scalar import clean_name, resolve
from tabforge.operators.binning import Bins


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, which is to be read several times, as a Parquet table under spark.checkpoint.dir: what it joins and shuffles is run
    once, and a pass reads only the columns it uses.  Without that setting: in a local folder where Spark is one process,
    else cached.  drop_kept() deletes the tables of the process."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            return df.persist()
        base = "file://" + tempfile.mkdtemp(prefix="tabforge-")
    path = f"{base.rstrip('/')}/tabforge-work/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    _kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


_kept: list[str] = []


def drop_kept(spark: SparkSession) -> int:
    """Deletes the tables that kept() has written, once the frames that read them are done with.  Returns how many there were."""
    n = len(_kept)
    while _kept:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_kept.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return n


def lines(spark: SparkSession, path: str, n: int | None = None) -> list[str]:
    """Lines of a small text file wherever Spark reads from; the first n of a large one."""
    df = spark.read.text(path)
    return [r[0] for r in (df.limit(n).collect() if n is not None else df.collect())]


def header(spark: SparkSession, path: str, delimiter: str = "|", header_path: str | None = None, header_delimiter: str | None = None, target: str | None = None) -> tuple[list[str], bool]:
    """Column names and whether the data's first line holds them: from a header file, from the first line if it names the
    target, else the numbers of the columns."""
    if header_path:
        return [clean_name(c.strip()) for c in lines(spark, header_path, 1)[0].split(header_delimiter or delimiter)], False
    first = (lines(spark, path, 1) or [""])[0].split(delimiter)
    if target and any(clean_name(c.strip()) == clean_name(target) for c in first):
        return [clean_name(c.strip()) for c in first], True
    return [str(i) for i in range(len(first))], False


def read_delimited(spark: SparkSession, path: str, delimiter: str = "|", names: list[str] | None = None, header_path: str | None = None, header_delimiter: str | None = None, target: str | None = None, glob: str | None = None) -> DataFrame:
    """All columns as text.  Compressed files and directories of parts are read as they are; rows of another number of
    fields go, and so does a header line wherever a part repeats it."""
    if names is None:
        names, _ = header(spark, path, delimiter, header_path, header_delimiter, target)
    reader = spark.read.option("lineSep", "\n")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    parts = reader.text(path).select(F.split("value", "\\Q" + delimiter + "\\E", -1).alias("f")).filter(F.size("f") == len(names))
    df = parts.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])
    t = resolve(clean_name(target), names) if target and any(clean_name(target) == n for n in names) else None
    return df.filter(F.col(f"`{t}`").isNull() | (F.regexp_replace(F.trim(F.col(f"`{t}`")), "[. /-]", "_") != t)) if t else df


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Only the columns asked for are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def with_validation(train: DataFrame, validation: DataFrame | None) -> DataFrame:
    """Both inputs with is_validation."""
    out = train.withColumn("is_validation", F.lit(False))
    return out if validation is None else out.unionByName(validation.withColumn("is_validation", F.lit(True)))


def write_delimited(df: DataFrame, path: str, delimiter: str = "|", compress: bool = False, with_header: bool = False, side_header: bool = True) -> None:
    """Delimited text, gzip on demand; the header in each file or beside the data in path + '.header'."""
    w = df.write.mode("overwrite").option("sep", delimiter).option("header", with_header).option("emptyValue", "")
    (w.option("compression", "gzip") if compress else w).csv(path)
    if side_header and not with_header:
        df.sparkSession.createDataFrame([(delimiter.join(df.columns),)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".header")


def write_parquet(df: DataFrame, path: str, partitions: int | None = None) -> None:
    (df.repartition(partitions) if partitions else df).write.mode("overwrite").parquet(path)


def name_list(spark: SparkSession, path: str) -> list[str]:
    """Column names of a list file: one a line, blank lines and # comments left out."""
    return [clean_name(x.strip()) for x in lines(spark, path) if x.strip() and not x.strip().startswith("#")]


def save_project(project: Project, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(project.to_json())


def load_project(path: str) -> Project:
    with open(path, encoding="utf-8") as f:
        return Project.from_json(f.read())


#: The schema of column metadata as it is saved.
META = T.StructType([
    T.StructField("column_name", T.StringType()), T.StructField("column_type", T.StringType()), T.StructField("column_flag", T.StringType()), T.StructField("selected", T.BooleanType()),
    T.StructField("stats", T.MapType(T.StringType(), T.DoubleType())), T.StructField("bounds", T.ArrayType(T.DoubleType())), T.StructField("groups", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("threshold", T.DoubleType()),
])


def save_meta(spark: SparkSession, meta: dict[str, dict], path: str) -> None:
    """Column metadata (column -> type, flag, selected, stats, bins) as JSON lines."""
    rows = [(c, m.get("type"), m.get("flag"), m.get("selected", False), {k: float(v) for k, v in m.get("stats", {}).items() if v is not None}, (b := m.get("bins")) and b.bounds or [], b and b.groups or [], b and b.threshold) for c, m in meta.items()]
    spark.createDataFrame(rows, META).coalesce(1).write.mode("overwrite").json(path)


def load_meta(spark: SparkSession, path: str) -> dict[str, dict]:
    out = {}
    for r in spark.read.schema(META).json(path).collect():
        out[r["column_name"]] = {"type": r["column_type"], "flag": r["column_flag"], "selected": r["selected"], "stats": dict(r["stats"] or {}), "bins": Bins(r["column_name"], list(r["bounds"] or []), [list(g) for g in r["groups"] or []], r["threshold"])}
    return out


def export_stats(meta: dict[str, dict]) -> str:
    """Column statistics as CSV."""
    keys = sorted({k for m in meta.values() for k in m.get("stats", {})})
    return "\n".join([",".join(["column", "type", "flag", "selected", *keys]), *[",".join([c, str(m.get("type") or ""), str(m.get("flag") or ""), str(m.get("selected", False)).lower(), *[f"{m['stats'][k]:.10g}" if k in m.get("stats", {}) else "" for k in keys]]) for c, m in meta.items()]]) + "\n"


def export_woe(bins: Bins, woe: list[float]) -> str:
    """A column's weights of evidence as a SQL expression."""
    if bins.kind == "C":
        cases = [f"WHEN trim({bins.name}) IN ({', '.join(repr(v) for v in g)}) THEN {woe[i]!r}" for i, g in enumerate(bins.groups)]
    else:
        cases = [f"WHEN TRY_CAST({bins.name} AS DOUBLE) < {hi!r} THEN {woe[i]!r}" for i, hi in enumerate(bins.bounds[1:])] + [f"WHEN TRY_CAST({bins.name} AS DOUBLE) IS NOT NULL THEN {woe[len(bins.bounds) - 1]!r}"]
    return f"CASE {' '.join(cases)} ELSE {woe[-1]!r} END"


def export_points(points: DataFrame, path: str) -> None:
    """Curve points as CSV with a header, one file for each curve."""
    points.coalesce(1).write.mode("overwrite").partitionBy("curve").option("header", True).csv(path)


def chart_html(points: list[dict], x: str, y: str, title: str) -> str:
    """A curve as a small page with an inline drawing."""
    p = sorted(points, key=lambda r: r["bucket"])
    top = max([r[y] for r in p] + [1e-9])
    path = " ".join(f"{20 + 360 * min(1.0, r[x]):.1f},{220 - 200 * r[y] / top:.1f}" for r in p)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title></head><body><h1>{title}</h1><svg width='400' height='240'><rect x='20' y='20' width='360' height='200' fill='none' stroke='#999'/><polyline fill='none' stroke='#06c' points='{path}'/></svg><script type='application/json'>{json.dumps(p, default=str)}</script></body></html>"


def pmml_linear(columns: list[str], weights: list[float], bias: float, name: str = "model") -> str:
    """A logistic model as PMML."""
    fields = "".join(f"<DataField name='{c}' optype='continuous' dataType='double'/>" for c in columns)
    used = "".join(f"<MiningField name='{c}'/>" for c in columns)
    terms = "".join(f"<NumericPredictor name='{c}' coefficient='{w!r}'/>" for c, w in zip(columns, weights, strict=True))
    return f"<?xml version='1.0' encoding='UTF-8'?><PMML version='4.4' xmlns='http://www.dmg.org/PMML-4_4'><Header/><DataDictionary numberOfFields='{len(columns)}'>{fields}</DataDictionary><RegressionModel modelName='{name}' functionName='regression' normalizationMethod='logit'><MiningSchema>{used}</MiningSchema><RegressionTable intercept='{bias!r}'>{terms}</RegressionTable></RegressionModel></PMML>"
