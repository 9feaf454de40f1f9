"""Secret scans with multipart credential linking.

Single parts are found by pattern in each row (spans come from the pieces between
matches, so a row is read in place and never shuffled): assigned secrets, access
identifiers and long hexadecimal strings count at once.  Weak candidates count only in
company: a random-looking string, a short assigned value, a login name or an endpoint
says little alone.  The parts of all documents form one table of intervals, cut into
scopes of ``reach`` code points; parts meet by an equi-join on document and scope, each
in all its scopes and partners in the next ones too, and a weak part is reported where
the parts near it complete it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import row_key, settled, table

VALUE = r"[A-Za-z0-9+/_.=-]+"
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          rf"({VALUE})")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # runs are whole, so this is [0-9a-f]+ of 16 and more
MIXED = r"[A-Za-z0-9+/_=-]{20,}"
LOGIN = r"(?i:user_?name|user|login|client_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]+"
ENDPOINT = r"https?://[A-Za-z0-9./_:?&=%#@~+-]+|[a-z0-9-]+(?:\.[a-z0-9-]+)*\.amazonaws\.com"

#: Order of kinds where two spans start at one place.
KINDS = ("assign", "access", "hex", "short", "mixed", "login", "endpoint")
#: What a part stands for when parts are linked.
ROLES = {"access": "id", "login": "id", "assign": "secret", "hex": "secret", "short": "secret",
         "mixed": "secret", "endpoint": "endpoint"}
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Spans of the leftmost non-overlapping matches that ``keep`` accepts.

    ``split`` gives what lies before each match, so the running lengths of pieces and
    matches are the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found,
                       lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))

    def add(done: Column, pair: Column) -> Column:
        start = done["at"] + pair["gap"]
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                        end.alias("end"))
        return F.struct(end.alias("at"), F.when(keep(pair["hit"]), F.array_append(
            done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    empty = F.array().cast(SPAN)
    summed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("spans")),
                         add)["spans"]
    return F.when(F.exists(found, keep), summed).otherwise(empty)


def _longer(least: int):
    return lambda hit: F.length(hit) >= least


def _value(hit: Column) -> Column:
    return F.length(F.regexp_extract(hit, f"^{ASSIGN}$", 2))


def _mixed(hit: Column) -> Column:
    return hit.rlike("[0-9]") & hit.rlike("[a-z]") & hit.rlike("[A-Z]")


def _always(hit: Column) -> Column:
    return F.lit(True)


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda span: span["kind"] == kind)).cast("long")


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, base spans and weak spans of each row, found in place."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(_spans(text, ASSIGN, "assign", lambda h: _value(h) >= 12),
                    _spans(text, ACCESS, "access", _longer(18)),
                    _spans(text, HEX, "hex", _longer(16)))
    weak = F.concat(_spans(text, ASSIGN, "short", lambda h: _value(h).between(6, 11)),
                    _spans(text, MIXED, "mixed", _mixed), _spans(text, LOGIN, "login", _always),
                    _spans(text, ENDPOINT, "endpoint", _always))
    return docs.select("doc_id", row_key().alias("row_key"), base.alias("base"),
                       weak.alias("weak"))


def linked(rows: DataFrame, reach: int) -> DataFrame:
    """The weak parts of each row that others complete, within ``reach`` code points.

    A secret is completed by an identifier; an identifier by a secret; an endpoint by an
    identifier and a secret, which may lie in it.  An identifier and a secret that overlap
    are one value and don't complete each other.
    """
    role = F.array(*[F.lit(ROLES[k]) for k in KINDS])
    parts = settled(
        rows.where(F.size("weak") > 0).dropDuplicates(["doc_id", "row_key"])
        .select("doc_id", "row_key", F.explode(F.concat("base", "weak")).alias("span"))
        .select("doc_id", "row_key", "span", F.col("span.start").alias("start"),
                F.col("span.end").alias("end"),
                F.element_at(role, F.col("span.kind") + 1).alias("role"))
        .withColumn("doc", F.coalesce("doc_id", F.lit(-1))), "secret-parts")
    first, last = F.floor(F.col("start") / reach), F.floor(F.col("end") / reach)
    scopes = F.sequence(first - 1, last + 1)
    near = (parts.where(F.col("role").isin("id", "secret"))
            .select("doc", "row_key", F.col("role").alias("by"), F.col("start").alias("from"),
                    F.col("end").alias("upto"), F.explode(scopes).alias("scope")))
    weak = parts.where(F.col("span.kind") >= KINDS.index("short")).withColumn(
        "scope", F.explode(F.sequence(first, last)))
    apart = F.greatest(F.col("from") - F.col("end"), F.col("start") - F.col("upto"))
    met = (weak.join(near, ["doc", "row_key", "scope"])
           .where((F.col("by") != F.col("role")) & (apart <= reach)
                  & ((apart >= 0) | (F.col("role") == "endpoint")))
           .groupBy("doc_id", "row_key", "span", "role")
           .agg(F.count_distinct("by").alias("kinds")))
    complete = F.col("kinds") >= F.when(F.col("role") == "endpoint", 2).otherwise(1)
    return (met.where(complete).groupBy("doc_id", "row_key")
            .agg(F.collect_set("span").alias("linked")))


def secret_scan(docs: DataFrame, reach: int = 256) -> DataFrame:
    """One row per document: its secrets' spans in code points, end exclusive.

    Base kinds are assign, access and hex; linked weak parts (short, mixed, login,
    endpoint) are added in ``spans``, each span once.  Null texts count as empty; empty
    texts have no spans and the digest of the empty string.  Rows alike get equal
    results.  Of the columns only doc_id and text are read.
    """
    rows = settled(scanned(docs), "secret-spans")
    added = linked(rows, reach).withColumnsRenamed({"doc_id": "__id", "row_key": "__key"})
    count = [_count("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    both = F.concat("base", F.coalesce("linked", F.array().cast(SPAN)))
    return (rows.join(added, F.col("doc_id").eqNullSafe(F.col("__id"))
                      & (F.col("row_key") == F.col("__key")), "left")
            .select("doc_id", *count,
                    F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                    _listed(both).alias("spans"),
                    F.size(F.coalesce("linked", F.array().cast(SPAN))).alias("n_linked")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
