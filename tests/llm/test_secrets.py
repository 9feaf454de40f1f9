import hashlib
import re

from footfall.llm.secrets import KINDS, op3_secret_scan, secret_scan
from tests.llm.rows import awkward, documents

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "")
            if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "")
            if len(m[0]) >= 16]
    return out


def digest(spans):
    listed = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return hashlib.sha256(listed.encode()).hexdigest()


def check(docs, rows):
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(digest(base(r.text)))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.base_sha256)
        spans = [s for s in r.spans.split(",") if s]
        assert r.n_assign + r.n_access + r.n_hex + r.n_linked == len(spans) == len(set(spans))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}


def test_base_spans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(docs, op3_secret_scan(spark, sf_dir).collect())


def test_awkward_rows(spark):
    docs = awkward(spark)
    check(docs, secret_scan(docs).collect())
    assert secret_scan(docs.limit(0)).count() == 0


def test_failing_matches_and_places(spark):
    docs = documents(spark, [
        "password:secret:abcdefghijklmnop", "😀 API_KEY = 'abcdefghijkl'", "AKIAAKIAAKIAAKIAAK",
        "0123456789abcdef0 0123456789abcde", "token=short token=longenough123", "ſecret=abcdefghijkl"])
    check(docs, secret_scan(docs).collect())


def test_weak_parts_need_company(spark):
    docs = documents(spark, [
        "😀 user: bob key AbCdEfGhIjKlMnOpQrSt1234 at https://a.b/c",
        "key AbCdEfGhIjKlMnOpQrSt1234 at https://a.b/c",
        "user: bob " + "far " * 100 + " AbCdEfGhIjKlMnOpQrSt1234"])
    spans = {r.doc_id: r.spans for r in secret_scan(docs).collect()}
    assert spans == {0: "login:2:11,mixed:16:40,endpoint:44:57", 1: "", 2: ""}


def test_long_and_overlapping_parts_meet(spark):
    long = "AbCd1" * 200
    docs = documents(spark, [f"{long}          user: bob", f"user: bob {long}",
                             "https://a.b/c?user=bob&token=abc123", long])
    spans = {r.doc_id: r.spans for r in secret_scan(docs).collect()}
    assert spans == {0: "mixed:0:1000,login:1010:1019", 1: "login:0:9,mixed:10:1010",
                     2: "endpoint:0:35,login:14:22,short:23:35", 3: ""}
