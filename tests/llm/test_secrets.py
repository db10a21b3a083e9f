import base64
import hashlib
import json
import random
import re
import time

from tabforge.llm import secrets


def brute_base(text):
    kinds = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    ]
    return [(m.start(), m.end(), k) for k, p, ok in kinds for m in p.finditer(text) if ok(m)]


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


RSA = der(0x30, b"".join([der(2, b"\0")] + [der(2, bytes([1 + i]) * 33) for i in range(8)]))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, bytes.fromhex("2b6570"))) + der(4, der(4, bytes(32))))
JWT = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256","typ":"JWT"}', b'{"sub":"12"}', b"0123456789abcdef0123"))


def kinds(text):
    return [k for _, _, k in secrets.spans(text) if k not in secrets.BASE]


def test_structures():
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(RSA).decode() + "-----END RSA PRIVATE KEY-----"
    assert kinds(f"x {pem} y") == ["pem"]
    body = base64.encodebytes(RSA).decode().replace("\n", "\r\n")
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\r\nProc-Type: 4,CLEAR\r\n\r\n{body}-----END RSA PRIVATE KEY-----") == ["pem"]
    assert kinds(f"-----BEGIN RSA PRIVATE KEY----- broken {pem}") == ["pem"] and kinds(pem.replace("END RSA", "END EC")) == []
    assert kinds(f"a {JWT} b") == ["jwt"]
    assert kinds(f"k {base64.b64encode(PKCS8).decode()} b") == ["der"]
    assert kinds(f"k {RSA.hex().upper()} b") == ["der"]
    assert kinds(base64.b64encode(b"password = hunter2hunter2hunter2").decode()) == ["wrapped"]
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 51) + field(b"s" * 136)
    assert kinds(base64.b64encode(ssh).decode()) == ["ssh"]


def test_base64url_keys_are_taken_whole():
    random.seed(5)
    late = 0
    for _ in range(200):
        value = base64.urlsafe_b64encode(der(0x30, b"".join([der(2, b"\0")] + [der(2, random.randbytes(129)) for _ in range(8)]))).decode()
        late += not set(value[:24]) & {"-", "_"} and bool(set(value) & {"-", "_"})
        assert secrets.confirmed(f"k {value} b") == [(2, 2 + len(value), "der")]
    assert late > 50
    plain = base64.b64encode(PKCS8).decode()
    assert secrets.confirmed(f"{plain}-end") == secrets.confirmed(f"{plain}_end") == [(0, len(plain), "der")]


def test_wrapped_text_that_is_not_ascii():
    text = "für Grüße: password = hunter2hunter2hunter2".encode()
    assert kinds(base64.b64encode(text).decode()) == kinds(text.hex()) == ["wrapped"]


def test_what_is_not_confirmed():
    assert kinds(base64.b64encode(bytes(range(60))).decode()) == []
    assert kinds(base64.b64encode(RSA[:-1]).decode()) == []
    assert kinds("eyJhbGciOiJub25lIn.abcd.efghijkl") == []
    assert kinds("supercalifragilisticexpialidociousandmore " * 3) == []


def test_base_against_brute_force(spark):
    random.seed(2)
    bits = ["token", "Secret", "apiKEY", "api_key", " ", " : ", "=", '"', "AKIA", "ABCDEF0123456789", "deadbeef00", "x", "é", "😀", "zz_12-3.4=", "\n", "pass", "passwd", "K", "ſecret"]
    rows = [(i, "".join(random.choice(bits) for _ in range(random.randrange(40)))) for i in range(400)] + [(0, None), (None, ""), (7, "y" * 200_000 + " token=abcdefghijklmnop")]
    got = {(r.doc_id, r.base_sha256): r for r in secrets.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        found = sorted(brute_base(t or ""), key=lambda s: (s[0], secrets.BASE.index(s[2])))
        r = got[i, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in found).encode()).hexdigest()]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == b for _, _, k in found) for b in secrets.BASE)
        assert {f"{k}:{s}:{e}" for s, e, k in found} <= set(r.spans.split(",")) | {""}


def test_redact(spark):
    rows = [(1, "a token=abcdefghijklmnop b", "k"), (2, None, "k"), (3, "plain", "k")]
    out = secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, secret_spans string"))
    assert [(r.doc_id, r.text, r.secret_spans) for r in out.orderBy("doc_id").collect()] == [(1, "a [SECRET] b", "k"), (2, None, "k"), (3, "plain", "k")]
    assert json.dumps(secrets.spans("")) == "[]"


def test_long_texts_take_time_in_proportion():
    for piece in ("-----BEGIN PRIVATE KEY-----", f"{JWT} ", "-----BEGIN ", base64.b64encode(PKCS8).decode() + " ", "ab+/-_" * 5 + " ", "password="):
        took = []
        for n in (20_000, 200_000):
            text = piece * (n // len(piece))
            began = time.perf_counter()
            secrets.spans(text)
            took.append(time.perf_counter() - began)
        assert took[1] < 40 * max(took[0], 0.02), piece


def test_planted_structures_in_a_table(spark):
    random.seed(15)
    forms = [base64.b64encode(RSA).decode(), base64.urlsafe_b64encode(RSA).decode(), PKCS8.hex(), JWT, "-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(PKCS8).decode() + "-----END PRIVATE KEY-----", base64.b64encode("password = hunter2hunter2-grün".encode()).decode()]
    noise = lambda n: base64.b64encode(random.randbytes(n)).decode()
    rows = [(i, f"some text {i} then {forms[i % len(forms)]} and more") for i in range(120)] + [(1000 + i, f"some text {noise(60)} {random.randbytes(24).hex().upper()} more") for i in range(120)]
    got = {r.doc_id: r.spans for r in secrets.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    structural = lambda s: [x for x in s.split(",") if x and x.split(":")[0] not in secrets.BASE]
    assert all(len(structural(got[i])) == 1 for i in range(120)) and not any(structural(got[1000 + i]) for i in range(120))
    for i in range(120):
        kind, a, b = structural(got[i])[0].split(":")
        assert rows[i][1][int(a) : int(b)].strip() == forms[i % len(forms)].strip()
