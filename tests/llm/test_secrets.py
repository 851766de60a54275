import hashlib
import random
import re

from quire.llm import queries, secrets

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute(text):
    """The base spans by whole-text searches."""
    text = text or ""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def crc_token(r, prefix="ghp_"):
    body = "".join(r.choice(secrets.BASE62) for _ in range(30))
    return prefix + body + secrets.base62_crc32(body)


def extended_key(r):
    raw = bytes.fromhex("0488ade4") + r.randbytes(74)
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, d = divmod(n, 58)
        out = secrets.BASE58[d] + out
    return out


def texts(r):
    parts = ["password", "PassWd=", "token", "tokentoken", "secret", "api_key", "apikey", "APIKEY", ":", "=", " ", "'", '"', "abcdefgh", "AKIA", "AKIAAKIA", "A1B2C3D4E5F6", "0123456789abcdef" * 2, "beef", "\n", "İ", "K", "ſecret=abcdefgh1", "toKen=abcdefgh", "é", "-"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)]


def test_base_equals_whole_searches():
    keywords = secrets.automaton()
    for t in [None, "", "password=password=abcdefgh", *texts(random.Random(1))]:
        assert [s for s in secrets.scan(t, keywords) if s[0] in ("assign", "access", "hex")] == brute(t), repr(t)


def test_checksums_decide():
    r, keywords = random.Random(2), secrets.automaton()
    for make in (crc_token, lambda r: crc_token(r, "npm_"), extended_key):
        good = make(r)
        bad = good[:10] + ("a" if good[10] != "a" else "b") + good[11:]
        kind = "extended_key" if good.startswith("xprv") else "crc_token"
        assert (kind, 2, 2 + len(good)) in secrets.scan(f"x {good} y", keywords)
        assert kind not in {k for k, _, _ in secrets.scan(f"x {bad} y", keywords)}
        assert kind not in {k for k, _, _ in secrets.scan(f"x {good}Z y", keywords)}


def test_query(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, t, "en") for i, t in enumerate([None, "", crc_token(r) + " token=" + "a" * 40, *texts(r)[:200], "long " * 50000 + "AKIA" + "B" * 20])] + [(1, "", None), (None, "secret: abcdefghi", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_secret_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = {}
    for d, t, _ in rows:
        base = brute(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want[d] = (*(sum(x[0] == k for x in base) for k in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest())
    for x in got:
        assert (x.n_assign, x.n_access, x.n_hex, x.base_sha256) == want[x.doc_id]
    assert next(x for x in got if x.doc_id == 2).spans.startswith("crc_token:0:40,assign:")
    empty = secrets.find_secrets(spark.createDataFrame([], "doc_id bigint, text string"))
    assert empty.collect() == []
