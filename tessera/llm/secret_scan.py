"""Secret scan with multipart credential linking, in DataFrame functions.

Base kinds are reported wherever they match.  Weak kinds (an account name,
an endpoint, a bare key) mean little alone: each has a scope of
``SCOPE_CHARS`` around it, and is reported only if parts of the other roles
of a credential (identifier, secret, endpoint) lie in that scope, with at
least one base part or parts of both other roles.  Scopes and parts meet in
an interval join on pieces of the text as wide as two scopes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.base import id_text, text_key, without
from tessera.session import checkpoint_dir

SCOPE_CHARS = 200
EVIDENCE = 2  # a base part counts 2, a weak one 1

#: The base patterns and the least length of what they match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs of [0-9a-f] with 24 or more characters
#: Weak patterns.
ACCOUNT = r"""(?i)(user_?name|user|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)"""
#: The scheme begins with the first letter of its run (after up to 32 digits
#: and signs), and a run is read once: no other letter of it is tried.
ENDPOINT = r"""(?<=(?:^|[^A-Za-z0-9+.-])[0-9+.-]{0,32})[A-Za-z][A-Za-z0-9+.-]*+://[^\s"'<>]++"""
KEY = r"[A-Za-z0-9+/_-]{32,}"

KINDS = ("assign", "access", "hex", "account", "endpoint", "key")
ROLES = ("secret", "identifier", "secret", "identifier", "endpoint", "secret")
N_BASE = 3


def _contains_any(text: Column, *parts: str) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(p))
    return found


def _kinds(text: Column) -> list[tuple[str, Column, Column]]:
    """(pattern, cheap condition for a text to have a match, condition on
    the match in the lambda variable it is given)."""
    set_sign = _contains_any(text, "=", ":")
    return [
        (ASSIGN, set_sign, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        (ACCESS, F.contains(text, F.lit("AKIA")), lambda m: F.length(m) >= 20),
        (HEX, F.lit(True), lambda m: F.lit(True)),
        (ACCOUNT, set_sign, lambda m: F.length(F.regexp_extract(m, ACCOUNT, 2)) >= 3),
        (ENDPOINT, F.contains(text, F.lit("://")), lambda m: F.lit(True)),
        (KEY, F.lit(True), lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")),
    ]


def _found(text: Column) -> Column:
    """Array of (kind, number, gap before, length, passes) of all matches."""
    lists = []
    for no, (pattern, possible, passes) in enumerate(_kinds(text)):
        pairs = F.zip_with(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
            lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))
        hits = F.transform(F.filter(pairs, lambda x: x["m"].isNotNull()), lambda x, i: F.struct(
            F.lit(no).alias("kind"), i.alias("number"), x["gap"].alias("gap"), F.length(x["m"]).alias("size"),
            passes(x["m"]).alias("ok")))
        none = F.array().cast("array<struct<kind:int,number:int,gap:int,size:int,ok:boolean>>")
        lists.append(F.when(possible & text.rlike(pattern), hits).otherwise(none))
    return F.concat(*lists)


def _place(matches: DataFrame) -> DataFrame:
    """(rid, kind, start, end): gaps and lengths summed up to each match."""
    before = Window.partitionBy("rid", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    return (matches.withColumn("end", F.sum(F.col("gap").cast("bigint") + F.col("size")).over(before))
            .filter("ok").select("rid", "kind", (F.col("end") - F.col("size")).alias("start"), "end"))


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """Weak spans with enough evidence of the other roles in their scope;
    those that touch a base span are part of it and dropped."""
    wide = 2 * scope
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("kind") + 1)
    parts = spans.withColumn("role", role)
    weak = parts.filter(F.col("kind") >= N_BASE).withColumn("piece", F.explode(F.sequence(
        F.floor((F.col("start") - scope) / wide), F.floor((F.col("end") + scope) / wide))))
    other = parts.withColumn("piece", F.explode(F.sequence(F.floor(F.col("start") / wide), F.floor(F.col("end") / wide))))
    w, o = weak.alias("w"), other.alias("o")
    met = w.join(o, (F.col("w.rid") == F.col("o.rid")) & (F.col("w.piece") == F.col("o.piece"))
                 & (F.col("o.start") < F.col("w.end") + scope) & (F.col("o.end") > F.col("w.start") - scope))
    is_base = F.col("o.kind") < N_BASE
    touches = is_base & (F.col("o.start") < F.col("w.end")) & (F.col("o.end") > F.col("w.start"))
    weight = F.when(is_base, 2).otherwise(1)
    evidence = [F.max(F.when((F.col("o.role") == r) & (F.col("w.role") != r), weight).otherwise(0)).alias(f"e_{r}")
                for r in ("identifier", "secret", "endpoint")]
    return (met.groupBy("w.rid", "w.kind", "w.start", "w.end")
            .agg(*evidence, F.max(touches).alias("touches"))
            .filter((F.col("e_identifier") + F.col("e_secret") + F.col("e_endpoint") >= EVIDENCE) & ~F.col("touches"))
            .select("rid", "kind", "start", "end"))


def _as_text(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def _count(kind: int) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind))


def scan(docs: DataFrame, scope: int = SCOPE_CHARS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, found (array
    of kind, start, end) and the key of the text: one row per input row.

    Places are code points, ends exclusive.  Null and empty texts have no
    spans (the digest is that of nothing).  Repeated rows get equal results,
    null ids are kept, other columns are ignored.  The texts are read once;
    matches travel as numbers, so no text is shuffled."""
    checkpoint_dir(docs.sparkSession)
    base = (id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
            .select("doc_id", text_key()[1].alias("text_key"), _found(F.col("text")).alias("matches"))
            .withColumn("rid", F.monotonically_increasing_id()).checkpoint())
    matches = base.filter(F.size("matches") > 0).select("rid", F.explode("matches").alias("x")).select("rid", "x.*")
    spans = _place(matches).checkpoint()
    reported = spans.filter(F.col("kind") < N_BASE).union(_linked(spans, scope))
    lists = reported.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))  # of one text
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    rows = base.join(lists, "rid", "left").withColumn("found", F.coalesce("found", none))
    own = F.filter("found", lambda s: s["kind"] < N_BASE)
    count = [_count(no).cast("bigint").alias(f"n_{KINDS[no]}") for no in range(N_BASE)]
    return rows.select("doc_id", *count, F.sha2(_as_text(own), 256).alias("base_sha256"),
                       _as_text(F.col("found")).alias("spans"), "found", "text_key")


def find_secrets(docs: DataFrame, scope: int = SCOPE_CHARS) -> DataFrame:
    """``scan`` without the helper columns."""
    return scan(docs, scope).drop("found", "text_key")


def keep_without_secrets(docs: DataFrame, scope: int = SCOPE_CHARS) -> DataFrame:
    """The rows of ``docs`` (all columns) in which no span is reported."""
    hit = scan(docs, scope).filter(F.size("found") > 0)
    return without(docs, hit.select(F.col("doc_id").alias("_key_id"), F.col("text_key").alias("_key_text")))
