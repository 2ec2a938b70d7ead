import hashlib
import re
import time

from pyspark.sql import functions as F

from brute import messy
from logspark.llm import secrets
from logspark.llm.queries import QUERIES

ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def check(query_rows, texts):
    for r in query_rows:
        spans = base_spans(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [
            sum(k == kind for _, _, k, _ in spans) for kind in ("assign", "access", "hex")]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_whole_table_against_python(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = QUERIES["op8_secrets"](spark, folder).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts) and sum(r.n_assign for r in found) > 10
    check(found, texts)


def test_spans_in_code_points(spark, tmp_path):
    hexed = "0123456789abcdef" * 2
    cases = {
        1: "", 2: None, 3: "password: token: abcdefghij", 4: f"\U0001F600é token='{hexed}' {hexed}{hexed}",
        5: "AKIAAKIA1234567890 AKIASHORT AKIAABCDEFGHIJKL", 6: f"{hexed} x " * 300, 7: "API_KEY = secret=abcdefgh12",
        8: "secret=token=abcdefgh password=short", 9: "pAsSwD\"  =  'abc/def+gh=", 10: f"g{hexed[:31]}g{hexed}",
        11: "-----BEGIN RSA PRIVATE KEY----- ghp_" + "z9" * 20}
    spark.createDataFrame(list(cases.items()), "doc_id bigint, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    found = QUERIES["op8_secrets"](spark, str(tmp_path)).collect()
    check(found, cases)
    assert next(r.spans for r in found if r.doc_id == 11) == "pem:0:31,github:32:76"


def test_ledger_scans_only_what_is_new(spark):
    hexed = "ab" * 16
    docs = messy(spark, [(1, f"a {hexed}"), (2, f"a {hexed}"), (2, f"a {hexed}"), (3, "token=abcdefgh1"), (None, None)])
    ledger = secrets.Ledger.fresh(spark)
    first = secrets.secrets(docs, ledger).collect()
    assert sorted((r.doc_id or 0, secrets_of(r)) for r in first) == [
        (0, ""), (1, "hex:2:34"), (2, "hex:2:34"), (2, "hex:2:34"), (3, "assign:0:15")]
    marks = ledger.scanned().count()
    assert marks == 3 * len(secrets.RULES) and ledger.findings().count() == 2
    secrets.update(ledger, docs)
    assert ledger.scanned().count() == marks
    secrets.update(ledger, messy(spark, [(9, "new AKIAABCDEFGHIJKL")]))
    assert ledger.scanned().count() == marks + len(secrets.RULES) and ledger.findings().count() == 3
    rules = tuple(r for r in secrets.RULES if r.kind != "hex") + (secrets.Rule("hex", 2, "[a-f]{3}", "[a-f]{3,}"),)
    again = secrets.secrets(docs, ledger, rules).collect()
    assert ledger.scanned().where("version = 2").count() == 3
    assert {secrets_of(r) for r in again if r.doc_id == 3} == {"assign:0:15,hex:6:12"}


def secrets_of(row):
    return ",".join(f"{f.kind}:{f.start}:{f.end}" for f in row.findings)


def test_masking_keeps_everything_else(spark):
    hexed = "ab" * 16
    rows = [(1, f"é token='{hexed}' and {hexed} end"), (2, "clean"), (3, None), (4, "")]
    docs = messy(spark, rows).withColumn("n_chars", F.length("text").cast("bigint"))
    clean = {r.doc_id: (r.text, r.n_chars) for r in secrets.without_secrets(docs).collect()}
    assert clean == {1: ("é [SECRET]' and [SECRET] end", 28), 2: ("clean", 5), 3: (None, None), 4: ("", 0)}
    assert secrets.without_secrets(docs).columns == docs.columns
    assert secrets.secrets(docs.limit(0)).collect() == []


def test_private_keys_go_whole(spark):
    body = "\n".join(["MIIEowIBAAKCAQEA" + "aB3+/xYz" * 6] * 25 + ["Qw9=="])
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    key = f"{begin}\n{body}\n{end}"
    headed = f"{begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123ABCD\n\n{body}\n{end}"
    cases = {
        1: (f"é before {key} after it", "é before [SECRET] after it"),
        2: (f"{key}\nand\n{key}\nend.", "[SECRET]\nand\n[SECRET]\nend."),
        3: (f"{headed} tail", "[SECRET] tail"),
        4: ('"key": "' + key.replace("\n", "\\n") + '\\n"', '"key": "[SECRET]\\n"'),
        5: (f"{begin}\n{body}\nProse goes on. {key}!", "[SECRET]\nProse goes on. [SECRET]!"),
        6: (key.replace("\n", "\r\n") + " x", "[SECRET] x"),
        7: (f"The line {begin} opens a key.", "The line [SECRET] opens a key."),
        8: (key.replace("\n", " ") + " x", "[SECRET] x"),
        9: (f"{begin}\n" + (body + "\n") * 30 + end + ".", "[SECRET]."),
    }
    docs = messy(spark, [(n, text) for n, (text, _) in cases.items()])
    clean = {r.doc_id: r.text for r in secrets.without_secrets(docs).collect()}
    assert clean == {n: want for n, (_, want) in cases.items()}


def test_overlapping_spans_are_masked_once_wherever_blocks_end(spark):
    size = secrets._BLOCK
    text = "".join(chr(0x1F600 + n % 50) if n % 7 == 0 else chr(97 + n % 26) for n in range(3 * size + 5))
    given = [[(0, 3), (2, 9), (9, 12)], [(size - 1, size), (size, size + 1)], [(10, 2 * size), (20, 30), (2 * size - 1, 2 * size)],
             [(0, len(text))], [(5, 6), (len(text) - 1, len(text))]]
    rows = [(str(n), start, end) for n, spans in enumerate(given) for start, end in spans]
    merged = secrets.stretches(spark.createDataFrame(rows, "blob string, start bigint, end bigint"))
    got = {r.blob: r.text for r in merged.select("blob", secrets.redacted(F.lit(text), F.col("spans"), "#").alias("text")).collect()}
    for n, spans in enumerate(given):
        want, at = "", 0
        for start, end in sorted(spans):
            want += text[at:start] + "#" if start >= at else ""
            at = max(at, end)
        assert got[str(n)] == want + text[at:]


def test_many_findings_in_a_long_text_take_linear_time(spark):
    line = "é token=abcdefgh%07d and more\n"
    text = "".join(line % n for n in range(32_000))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.monotonic()
    assert secrets.without_secrets(docs).first().text == "é [SECRET] and more\n" * 32_000
    assert time.monotonic() - began < 60


def test_an_increment_leaves_known_texts_where_they_are(spark):
    ledger = secrets.Ledger.fresh(spark)
    docs = spark.createDataFrame([(n, f"text {n} token=abcdefgh{n}") for n in range(50)], "doc_id bigint, text string")
    secrets.update(ledger, docs)
    more = docs.unionByName(spark.createDataFrame([(99, "new AKIAABCDEFGHIJKL")], docs.schema))
    scanned = []
    whole = secrets.scan
    try:
        secrets.scan = lambda blobs, rules: scanned.append(blobs.count()) or whole(blobs, rules)
        found = {r.doc_id: secrets_of(r) for r in secrets.secrets(more, ledger).collect()}
    finally:
        secrets.scan = whole
    assert scanned == [1] and len(found) == 51 and found[99] == "access:4:20" and found[3] == "assign:7:22"
    assert len(secrets.secrets(docs.where("doc_id < 2"), ledger).collect()) == 2
