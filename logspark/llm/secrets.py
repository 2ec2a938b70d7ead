"""Secret scans over an incremental blob ledger.

Every text version is addressed by its content (SHA-256). The ledger holds the pairs of blob and rule
version already scanned, and their findings. A scan takes the blobs of the given rows, leaves out the
pairs that the ledger has, scans what is left once per blob and rule, and joins findings back to all paths (rows)
that show the blob. A text with a thousand copies is scanned once; a new rule version scans old blobs for
that rule only. Only DataFrame functions are used.

Spans are [start, end) in code points of the text. Matches of a rule are found left to right without overlap; the
text between them and the matches' lengths, summed up in a window over the blob, give the positions, whatever
the number of matches.

Cases: null text is empty and has no finding; repeated rows are paths of one blob; other columns play no part in
the scan; empty tables give none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logspark.llm.common import texts
from logspark.session import shared_path, sized, written


@dataclass(frozen=True)
class Rule:
    """``hint`` is a cheap pattern that every text with a match has; ``group`` of at least ``least``
    characters decides whether a match counts. Base rules keep all their spans."""

    kind: str
    version: int
    hint: str
    pattern: str
    group: int = 0
    least: int = 0


#: A private key: its BEGIN line, then up to the END line what a body has, after a few header lines. Without an END line it
#: ends with the run of base64 lines. Line ends may be written as \\n.
_END = r"(?:[\x20\t>|#\"']*+(?:\r?\n|\\r|\\n)|[\x20\t])[\s>|#\"']*+(?:\\[nr])*+[\x20\t]*+"
_HEADERS = rf"(?:{_END}[A-Za-z][A-Za-z0-9-]{{0,30}}:\x20[^\n\\]{{0,200}}){{0,8}}"
_PEM = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:"
    rf"{_HEADERS}[A-Za-z0-9+/=\s\\>|#\"',]*+-----END [A-Z ]{{0,40}}PRIVATE KEY-----"
    rf"|{_HEADERS}(?:{_END}[A-Za-z0-9+/]{{20,}}+={{0,2}}){{1,1000}}"
    rf"(?:{_END}(?=[A-Za-z]{{0,19}}[0-9+/=])[A-Za-z0-9+/]{{1,19}}+={{0,2}}(?=[\s\\\"']|$))?)?")

#: The agreed forms come first, in the order of their kinds; the rest are further well-known token shapes.
RULES = (
    Rule("assign", 1, r"(?i)passw|secret|token|api_?key",
         r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, "AKIA", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, "[0-9a-f]{32}", "[0-9a-f]{32,}", 0, 32),
    Rule("pem", 3, "-----BEGIN ", _PEM),
    Rule("github", 1, "gh[pousr]_", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, "xox[abprs]-", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", 1, r"eyJ", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", 1, "AIza", r"AIza[A-Za-z0-9_-]{35}"),
)
BASE = ("assign", "access", "hex")
FINDING = "blob string, kind string, version int, start bigint, end bigint"
SCANNED = "blob string, kind string, version int"
#: Characters of a block in which a text is looked up when it is masked.
_BLOCK = 1024


class Ledger:
    """The tables ``scanned`` and ``findings`` below ``path``; rows are only ever added."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def fresh(cls, spark: SparkSession) -> Ledger:
        return cls(spark, shared_path(spark, "ledger"))

    def _table(self, name: str, schema: str) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.read.schema(schema).parquet(str(where))
        return self.spark.range(0).select(*[
            F.lit(None).cast(kind).alias(column) for column, kind in (c.split() for c in schema.split(", "))])

    def scanned(self) -> DataFrame:
        return self._table("scanned", SCANNED)

    def findings(self) -> DataFrame:
        """One row per finding; a scan repeated after a failure adds rows already there, so they're told apart."""
        return self._table("findings", FINDING).distinct()

    def add(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")


def blob_id(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _todo(rules: tuple[Rule, ...]) -> Column:
    """Rules whose hint the text has, by number."""
    return F.array_compact(F.array(*[F.when(F.col("text").rlike(r.hint), F.lit(n)) for n, r in enumerate(rules)]))


def _matches(rule: Rule) -> Column:
    """Per match: length of the text before it since the last one, its own length, whether it counts."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all("text", pattern, F.lit(0))
    gaps = F.transform(F.split("text", rule.pattern, -1), F.length)
    if rule.group:
        counted = F.transform(
            F.regexp_extract_all("text", pattern, F.lit(rule.group)), lambda x: F.length(x) >= rule.least)
    else:
        counted = F.transform(whole, lambda x: F.length(x) >= rule.least)
    # The text after the last match has a gap and no match; it falls away with its null.
    return F.filter(F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("size"), counted.alias("counts")),
                    lambda m: m["size"].isNotNull())


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of ``blobs`` (blob, text), each of which is there once."""
    hinted = blobs.withColumn("_rules", _todo(rules)).where(F.size("_rules") > 0)
    each = F.col("_rule")
    matches = None
    for n, rule in enumerate(rules):
        matches = F.when(each == n, _matches(rule)) if matches is None else matches.when(each == n, _matches(rule))
    found = hinted.select("blob", "text", F.explode("_rules").alias("_rule")).select(
        "blob", "_rule", F.posexplode(matches).alias("_n", "_m")).select(
        "blob", "_rule", "_n", "_m.gap", "_m.size", "_m.counts")
    upto = W.partitionBy("blob", "_rule").orderBy("_n").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum((F.col("gap") + F.col("size")).cast("bigint")).over(upto)
    names = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    return found.withColumn("end", end).where("counts").select(
        "blob", F.get(names, F.col("_rule"))["kind"].alias("kind"),
        F.get(names, F.col("_rule"))["version"].alias("version"), (F.col("end") - F.col("size")).alias("start"), "end")


def update(ledger: Ledger, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring ``ledger`` up to date with the texts of ``docs``; gives the paths (doc_id, blob)."""
    addressed = texts(docs).withColumn("blob", blob_id(F.col("text")))
    paths = written(addressed.select("doc_id", "blob"), "paths")
    seen = ledger.scanned()
    blobs = paths.select("blob").distinct()
    wanted = blobs.withColumn("_r", F.explode(F.array(*[
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]))).select("blob", "_r.*")

    def scanned(given: DataFrame, lacking: tuple[Rule, ...]) -> None:
        # Findings before marks: a failure in between only means that a scan is repeated.
        ledger.add("findings", scan(given.groupBy("blob").agg(F.first("text").alias("text")), lacking))

    if seen.isEmpty():
        scanned(addressed, rules)
        ledger.add("scanned", wanted)
        return paths
    unseen = written(wanted.join(seen, ["blob", "kind", "version"], "left_anti"), "unseen")
    # One scan for each set of rules that some blobs still lack: two after a new rule. Texts of other blobs stay where they are.
    gaps = written(unseen.groupBy("blob").agg(F.sort_array(F.collect_set("kind")).alias("kinds")), "gaps")
    for row in gaps.select("kinds").distinct().collect():
        lacking = tuple(r for r in rules if r.kind in row["kinds"])
        scanned(addressed.join(sized(gaps.where(F.col("kinds") == F.lit(row["kinds"])).select("blob")), "blob", "left_semi"), lacking)
    ledger.add("scanned", unseen)
    return paths


def _found(docs: DataFrame, ledger: Ledger | None, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """Paths (doc_id, blob) of ``docs``, and the findings by ``rules`` (blob, kind, start, end, place of the kind) of their blobs."""
    ledger = ledger or Ledger.fresh(docs.sparkSession)
    filled = not ledger.scanned().isEmpty()
    paths = update(ledger, docs, rules)
    current = None
    for place, rule in enumerate(rules):
        hit = (F.col("kind") == rule.kind) & (F.col("version") == rule.version)
        current = F.when(hit, F.lit(place)) if current is None else current.when(hit, F.lit(place))
    rows = ledger.findings().withColumn("place", current).where("place is not null")
    # A ledger that was empty has findings of these blobs only.
    return paths, rows.join(paths.select("blob").distinct(), "blob", "left_semi") if filled else rows


def secrets(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, findings) of every row; ``findings`` are (start, place of the kind, kind, end), sorted."""
    paths, rows = _found(docs, ledger, rules)
    by_blob = rows.groupBy("blob").agg(
        F.sort_array(F.collect_list(F.struct("start", "place", "kind", "end"))).alias("findings"))
    empty = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")
    return paths.join(by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("findings", empty).alias("findings"))


def span_text(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(
        ":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def of_kinds(findings: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(findings, lambda f: f["kind"].isin(*kinds))


def count_kind(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("bigint")


def stretches(findings: DataFrame) -> DataFrame:
    """(blob, spans): the findings' spans as (start, end), sorted, those that overlap as one."""
    before = W.partitionBy("blob").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(W.unboundedPreceding, -1))
    fresh = findings.withColumn("_fresh", (F.col("start") >= F.coalesce(reach, F.lit(0))).cast("int"))
    joined = fresh.withColumn("_n", F.sum("_fresh").over(before.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return joined.groupBy("blob", "_n").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("blob").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with each of ``spans``, sorted and apart, replaced by ``mask``.

    Places are looked up in blocks of the text, so the work is linear in the text and in the spans.
    """
    def between(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / _BLOCK).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, F.floor(end / _BLOCK).cast("int") - first + 1), "")
        return F.substring(near, (start - first * _BLOCK + 1).cast("int"), (end - start).cast("int"))

    def pieces(held: Column) -> Column:
        nothing, whole = F.lit(0).cast("bigint"), held["size"]
        kept = F.transform(F.sequence(F.lit(0), F.size(held["spans"])), lambda i: between(
            held["blocks"], F.when(i == 0, nothing).otherwise(F.get(held["spans"], i - 1)["end"]),
            F.coalesce(F.get(held["spans"], i)["start"], whole)))
        return F.array_join(kept, mask)

    # A lambda's variable is worked out once, whatever is read from it.
    held = F.struct(
        F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0)).alias("blocks"), spans.alias("spans"),
        F.length(text).cast("bigint").alias("size"))
    return F.get(F.transform(F.array(held), pieces), F.lit(0))


def without_secrets(docs: DataFrame, ledger: Ledger | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``docs``, all columns, with secrets masked in ``text`` and ``n_chars`` brought up to date."""
    found = stretches(_found(docs, ledger, RULES)[1])
    marked = docs.withColumn("_blob", blob_id(F.col("text").cast("string"))).join(
        found.select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans")), "_blob", "left")
    clean = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("_spans"), mask))
    columns = [clean.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    result = marked.select(*columns)
    return result.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if (
        "n_chars" in docs.columns) else result
