"""Secret scans over an incremental blob ledger (DataFrame functions only).

Every version of every text is content-addressed: its blob id is the SHA-256 of the whole text.
The ledger holds one row per (blob, rule version) already scanned, with its findings. A scan

1. lists the distinct blobs of the given versions and drops (anti join) those the ledger has
   for this rule version,
2. runs the rules over one copy of each unseen blob,
3. appends the outcome, empty ones too, to the ledger, and
4. joins findings back to every path (row) that holds the blob.

Positions come from built-in functions: ``split`` by a rule's pattern gives the pieces between
matches, ``regexp_extract_all`` the matches; a running sum of both lengths, over the rows of one
blob and rule, gives the spans, in code points. The rows of a blob stay in the partition that
its text came to, so the sum needs no further shuffle, and time grows with the number of matches.
A rule's patterns only run on texts that contain one of its literal hints.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillstar.llm.common import fresh, quoted, stage, table

SPAN = "struct<kind:string,start:int,end:int>"


@dataclass(frozen=True)
class Rule:
    """``tail`` marks the end of a match that is measured against ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    tail: str = ""  # pattern whose match, taken from the whole match, must have `least` characters
    hints: tuple[str, ...] = ()  # lower-case literals, one of which a match must contain


# The base rules, in the order of their kinds.
BASE = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        6,
        r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 20, "", ("akia",)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Kinds the method adds.
EXTRA = (
    Rule(
        "private_key",
        # the whole key: header lines and base64 up to END, or the base64 lines if END is missing
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\x09-\x0D\x20]*(?:Proc-Type:[^\x0A\x0D]*[\x0A\x0D]+)?(?:DEK-Info:[^\x0A\x0D]*[\x0A\x0D]+)?"
        r"[A-Za-z0-9+/=\\\x09-\x0D\x20]*-----END [A-Z ]*PRIVATE KEY-----|[\x0A\x0D]+[A-Za-z0-9+/=]{16}[A-Za-z0-9+/=\x0A\x0D]*)?",
        0,
        "",
        ("private key-----",),
    ),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, "", ("eyj",)),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9+/_.=-]{16,}", 0, "", ("bearer",)),
    # of a longer scheme the span takes the last 21 characters
    Rule("url_login", r"[a-z][a-z0-9+.-]{0,20}://[^\x09-\x0D\x20/:@]+:[^\x09-\x0D\x20/:@]+@", 0, "", ("://",)),
)
RULES = BASE + EXTRA
RULE_VERSION = "3"


def matches(text: Column, low: Column, rule: Rule, nth: int) -> Column:
    """Array of a rule's matches in a text: rule, number, length of gap and match, and whether it counts."""
    hinted = F.lit(True)
    if rule.hints:
        hinted = F.contains(low, F.lit(rule.hints[0]))
        for h in rule.hints[1:]:
            hinted = hinted | F.contains(low, F.lit(h))
    hits, gaps = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    ok = lambda h: F.length(F.regexp_extract(h, rule.tail, 1) if rule.tail else h) >= rule.least
    one = lambda h, g: F.struct(
        F.lit(nth).alias("nth"), F.coalesce(F.length(g), F.lit(0)).alias("gap"), F.length(h).alias("size"), ok(h).alias("ok")
    )
    pairs = F.filter(F.zip_with(hits, gaps, lambda h, g: F.when(h.isNotNull(), one(h, g))), lambda p: p.isNotNull())
    return F.when(hinted, pairs).otherwise(F.array().cast("array<struct<nth:int,gap:int,size:int,ok:boolean>>"))


def find(blobs: DataFrame, text: str, low: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, findings): all spans of all rules, by start, then the order of the rules. One row per blob in, one out."""
    every = F.concat(*[matches(F.col(text), F.col(low), r, i) for i, r in enumerate(rules)])
    rows = blobs.select("blob", F.posexplode_outer(every).alias("pos", "m")).select("blob", "pos", "m.*")
    run = Window.partitionBy("blob", "nth").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(run).cast("int"))
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("nth") + 1)
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "nth", "end", kind.alias("kind"))
    found = rows.groupBy("blob").agg(F.array_sort(F.collect_list(F.when(F.col("ok"), span))).alias("found"))
    return found.select(
        "blob", F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("findings")
    )


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
    rule_version: str = RULE_VERSION,
) -> tuple[DataFrame, DataFrame]:
    """(rows of ``versions`` with ``blob`` and ``findings``, new ledger rows).

    ``ledger`` has blob, rule_version and findings of earlier scans; its blobs are not scanned
    again for the same rule version. New ledger rows are written to the shared folder, one per
    blob scanned now, and should be appended to the ledger. A null text is the empty blob.
    Repeated rows share a blob and keep their own result row. Input columns named blob or
    findings are replaced; other columns pass through. A very long text is scanned whole, its
    matches are rows of its blob. Without rows both results are empty.
    """
    keep = [c for c in versions.columns if c.lower() not in ("blob", "findings")]
    body, low, known = fresh("body"), fresh("low"), fresh("known")
    rows = versions.select(*quoted(keep), blob_id(F.col(text)).alias("blob"))
    blobs = versions.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias(body))
    mine = None
    if ledger is not None:
        mine = ledger.filter(F.col("rule_version") == rule_version).select("blob", "findings").dropDuplicates(["blob"])
        blobs = blobs.join(mine.select("blob"), "blob", "left_anti")
    # one copy of each blob: map tasks drop their own copies first, so a hot blob stays small
    unseen = blobs.groupBy("blob").agg(F.first(body).alias(body)).withColumn(low, F.lower(body))
    fresh_rows = stage(
        find(unseen, body, low, rules).select("blob", F.lit(rule_version).alias("rule_version"), "findings"),
        "secret-ledger",
    )
    everything = fresh_rows.select("blob", "findings")
    if mine is not None:
        everything = everything.unionByName(mine)
    hits = everything.filter(F.size("findings") > 0).withColumnsRenamed({"blob": known})
    out = rows.join(hits, F.col("blob") == F.col(known), "left").drop(known)
    none = F.array().cast(f"array<{SPAN}>")
    return out.withColumn("findings", F.coalesce("findings", none)), fresh_rows


def redact(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text with every found span replaced by the mark; overlapping spans become one.

    With starts and ends sorted apart, a new stretch begins at start i where the i-th end lies at
    or before it: all spans that began earlier are over. The text is cut into characters once.
    """
    bound = F.array(
        F.struct(
            F.split(text, "").alias("c"),
            F.transform(findings, lambda s: s["start"]).alias("s"),
            F.array_sort(F.transform(findings, lambda s: s["end"])).alias("e"),
        )
    )

    def cut(v: Column) -> Column:
        end_before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(v["e"], i - 1))
        new = F.filter(F.sequence(F.lit(0), F.size(v["s"]) - 1), lambda i: end_before(i) <= F.get(v["s"], i))
        piece = lambda i: F.array_join(F.slice(v["c"], end_before(i) + 1, F.get(v["s"], i) - end_before(i)), "")
        last = F.element_at(v["e"], -1)
        tail = F.array_join(F.slice(v["c"], last + 1, F.greatest(F.size(v["c"]) - last, F.lit(0))), "")
        return F.array_join(F.concat(F.transform(new, piece), F.array(tail)), mark)

    return F.when(F.size(findings) > 0, F.element_at(F.transform(bound, cut), 1)).otherwise(text)


def _listed(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, _ = scan(docs)
    base = F.filter("findings", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("findings")).alias("spans"),
    )


def _oracle() -> str:
    """Each regular expression runs once a text; spans are running sums over unnested matches."""
    names = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    assign = names + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    q = lambda p: p.replace("'", "''")
    rules = [("assign", assign, f"length(regexp_extract(hit, '{q(assign)}', 2)) >= 6"), ("access", "AKIA[A-Z0-9]+", "length(hit) >= 20")]
    rules += [("hex", "[0-9a-f]+", "length(hit) >= 24")] + [(r.kind, r.pattern, "true") for r in EXTRA]
    lists = "\n  UNION ALL ".join(
        f"SELECT r, '{k}' AS k, {i} AS n, regexp_extract_all(t, '{q(p)}') AS h, string_split_regex(t, '{q(p)}') AS g FROM d WHERE regexp_matches(t, '{q(p)}')"
        for i, (k, p, _) in enumerate(rules)
    )
    ok = "CASE n " + " ".join(f"WHEN {i} THEN {c}" for i, (_, _, c) in enumerate(rules)) + " END"
    joined = "coalesce(string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, n){}, '')"
    base = len(BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({lists}),
u AS (SELECT r, k, n, unnest(h) AS hit, unnest(g[1:len(h)]) AS gap, unnest(range(len(h))) AS i FROM x),
p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, n ORDER BY i) AS e FROM u),
f AS (SELECT r, k, n, (e - length(hit))::BIGINT AS s, e::BIGINT AS e FROM p WHERE {ok})
SELECT doc_id, count(*) FILTER (WHERE n = 0)::BIGINT AS n_assign, count(*) FILTER (WHERE n = 1)::BIGINT AS n_access,
  count(*) FILTER (WHERE n = 2)::BIGINT AS n_hex, sha256({joined.format(f" FILTER (WHERE n < {base})")}) AS base_sha256,
  {joined.format(" FILTER (WHERE n IS NOT NULL)")} AS spans
FROM d LEFT JOIN f USING (r) GROUP BY r, doc_id
"""


OP8_SQL = _oracle()
