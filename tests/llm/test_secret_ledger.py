import hashlib
import re

import pytest
from cases import prose
from pyspark.sql import functions as F

from edgelight.llm import secret_ledger as sl
from edgelight.llm.common import staged

AWS, HEX = "AKIA" + "Q7" * 9, "0123456789abcdef" * 2
LONG = prose(50_000, 41) + f" token={HEX} " + prose(50_000, 42)
TEXTS = [
    None, "", "plain words", f"token = \"{HEX}\"", f"é日😀 PassWord: 'hunter2x' then {AWS}", f"api_key={AWS} apikey:{HEX}", "secret: short token=abcdef passwd  =  \"a.b/c_d-e\"", f"{HEX}g{HEX[:20]} {HEX[:23]} {AWS[:19]}",
    "ſecret=abcdefgh toKen=abcdefgh", "token=token=abcdefg password: secret=x12345", LONG, LONG, f"token = \"{HEX}\"",
    "-----BEGIN RSA PRIVATE KEY-----\nMIIabc+/=\n-----END RSA PRIVATE KEY-----", "https://joe:pw123@host/x ghp_" + "a1B2" * 9, "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh_-",
]
ROWS = [(i, t, "own", "own", "own") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "", "", ""), (None, None, "", "", ""), (3, TEXTS[3], "", "", ""), (3, TEXTS[3], "", "", ""), (3, TEXTS[4], "", "", "")]
SCHEMA = "doc_id long, text string, blob string, holder string, spans string"


def plain(text):
    """All spans of a text by code points: Python's own matching over text, not bytes."""
    found = []
    for rank, rule in enumerate(r for p in (sl.BASE, sl.FORMATS) for r in p.rules):
        for m in re.finditer(rule.pattern, text or "", re.ASCII | (re.IGNORECASE if rule.folded else 0)):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), rank, m.end(), rule.kind))
    return sorted(found)


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def result(df):
    return sorted(((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in df.collect()), key=repr)


def test_every_row_has_its_spans(spark):
    got = result(sl.scan_history(frame(spark), sl.new_ledger(spark)))
    assert got == sorted(((r[0], plain(r[1])) for r in ROWS), key=repr)
    assert {k for _, spans in got for *_, k in spans} == set(sl.KINDS)
    assert result(sl.scan_history(frame(spark, []), sl.new_ledger(spark))) == []


def scanned(ledger):
    return sorted((bytes(r["blob"]).hex(), r["version"]) for r in ledger.rows().collect())


def blob(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_only_unseen_blobs_and_versions_are_scanned(spark):
    ledger = sl.new_ledger(spark)
    base, formats = sl.BASE.version, sl.FORMATS.version
    old = [r for r in ROWS if r[0] is None or r[0] < 8]
    sl.scan_history(frame(spark, old), ledger, (sl.BASE,))
    first = {(blob(r[1]), base) for r in old}
    assert scanned(ledger) == sorted(first)  # each content once, whatever the number of rows that hold it
    got = result(sl.scan_history(frame(spark), ledger, (sl.BASE,)))  # more history: only its new content
    assert scanned(ledger) == sorted({(blob(r[1]), base) for r in ROWS})
    assert got == sorted(((r[0], [s for s in plain(r[1]) if s[1] < 3]) for r in ROWS), key=repr)
    sl.scan_history(frame(spark, old), ledger)  # one more pack: only that, only for the content asked for
    assert scanned(ledger) == sorted({(blob(r[1]), base) for r in ROWS} | {(b, formats) for b, _ in first})
    before = scanned(ledger)
    assert result(sl.scan_history(frame(spark, old), ledger)) == sorted(((r[0], plain(r[1])) for r in old), key=repr)
    assert scanned(ledger) == before  # nothing left to scan


def test_what_the_ledger_says_counts(spark):
    """Findings come from the ledger: a blob that it calls clean is not looked at again."""
    ledger = sl.new_ledger(spark)
    rows = [(bytes.fromhex(blob(TEXTS[3])), p.version, []) for p in (sl.BASE, sl.FORMATS)]
    ledger.add(spark.createDataFrame(rows, sl.Ledger.SCHEMA))
    ledger.add(spark.createDataFrame(rows, sl.Ledger.SCHEMA))  # two runs at once
    got = result(sl.scan_history(frame(spark), ledger))
    assert got == sorted(((r[0], [] if r[1] == TEXTS[3] else plain(r[1])) for r in ROWS), key=repr)


def test_changed_rules_are_a_new_version():
    changed = sl.Pack("base", (*sl.BASE.rules, sl.Rule("more", "x+")))
    assert changed.version != sl.BASE.version and sl.Pack("base", sl.BASE.rules).version == sl.BASE.version


def test_keys_of_several_columns(spark):
    rows = [("a.py", 1, f"token={HEX}"), ("a.py", 2, "clean"), ("b.py", 2, f"token={HEX}"), (None, None, f"token={HEX}")]
    found = sl.scan_history(spark.createDataFrame(rows, "path string, version int, text string"), sl.new_ledger(spark), keys=("path", "version"))
    assert sorted((r["path"] or "", r["version"] or 0, len(r["spans"])) for r in found.collect()) == [("", 0, 2), ("a.py", 1, 2), ("a.py", 2, 0), ("b.py", 2, 2)]


@pytest.mark.parametrize("text", [t or "" for t in TEXTS])
def test_hints_lose_no_match(text):
    data = text.encode()
    for rule in (r for p in (sl.BASE, sl.FORMATS) for r in p.rules):
        bare = sl.Rule(rule.kind, "(?:" + rule.pattern + ")", rule.group, rule.least, rule.folded)
        assert sl.matches(data, data.lower(), rule, sl._compiled(rule)) == sl.matches(data, data.lower(), bare, sl._compiled(bare))


def test_query_digests(spark, small):
    rows = {r["doc_id"]: r for r in sl.op12_blob_ledger(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        spans, r = plain(d["text"]), rows[d["doc_id"]]
        base = ",".join(f"{k}:{s}:{e}" for s, i, e, k in spans if i < 3)
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans) and r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[3] == k for x in spans) for k in ("assign", "access", "hex")]


def test_a_text_of_many_rows_is_moved_once(spark):
    docs = staged(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(f"token={HEX}").alias("text")))
    ledger = sl.new_ledger(spark)
    assert sl.scan_history(docs, ledger).where(F.size("spans") == 2).count() == 3000
    assert ledger.rows().count() == 2
