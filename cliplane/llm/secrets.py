"""Secret scan with multipart credential linking [DataFrame functions only].

Strong kinds (assign, access, hex) are always reported. Weak parts (identifiers, secret-looking strings, endpoints) are
reported only where complementary parts co-occur: an identifier with a secret, a secret with an identifier or endpoint, an
endpoint with an identifier and a secret. Two parts co-occur if they stand in one scope (a stretch of text without a blank
line) and at most GAP code points lie between the end of one and the start of the other, whatever their own lengths.

The interval join runs inside each text that has a weak part: its parts and blank lines are rows in the order of position,
and two windows carry the part of each kind that ends last before a row (forwards) and starts first behind it (backwards).
So it is linear in the parts and makes no pairs. Rows are told apart by a number that is written with them, so copies of a
text are rows of their own and no key is hot.

Edge cases: null text counts as empty and has no spans. Repeated rows are scanned each by itself. Positions are code
points, ends exclusive. Ties at one start are ordered by kind. An empty table gives no rows. Kept columns may have any
names; one that is called base, all or links gives way to the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplane.llm.common import materialise, quoted

#: Patterns of the strong kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs are maximal, so asking for 24 finds the same spans as dropping shorter runs.
LONG_HEX = r"[0-9a-f]{24,}"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Patterns of weak parts. Names of accounts, mail addresses and cloud identifiers; a secret-looking string has small and
#: capital letters and digits; addresses of services with or without a scheme, and hosts by name or number. Runs are
#: maximal, and those that can be long are possessive, so a failed match isn't tried again from within.
_SET = r"""["']?\x20*[:=]\x20*["']?"""
WEAK_ID = (
    rf"""(?i:client_?id|tenant_?id|account_?id|account_?name|user_?id|user_?name|user|login|e-?mail|access_?key_?id|key_?id){_SET}[A-Za-z0-9_.@-]{{4,}}"""
    r"""|(?:ASIA|AIDA|AROA|AGPA|ANPA)[A-Z0-9]{12,}"""
    r"""|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"""
)
_RUN = "[A-Za-z0-9+/_-]"
WEAK_SECRET = f"(?<!{_RUN})(?={_RUN}*[0-9])(?={_RUN}*[a-z])(?={_RUN}*[A-Z]){_RUN}{{32,}}"
WEAK_ENDPOINT = (
    r"(?:https?|wss?|postgres|postgresql|mysql|mongodb(?:\+srv)?|redis|amqps?|ftp|sftp|ssh|smtp|ldaps?|s3|jdbc:[a-z]+)://[A-Za-z0-9._~:@/-]{3,}"
    rf"|(?i:host|host_?name|server|endpoint|domain){_SET}[A-Za-z0-9.-]{{3,}}(?::[0-9]{{1,5}})?"
    r"|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])"
)
#: What ends a scope.
BLANK_LINE = r"\n[\x20\x09\r]*\n"
#: Kinds in the order of the report, and the part that each is.
KINDS = {"assign": "secret", "access": "id", "hex": "secret", "id": "id", "secret": "secret", "endpoint": "endpoint"}
#: Kind of a blank line among the parts of a text.
BREAK = len(KINDS)
#: Most code points between two parts that belong together.
GAP = 256
SPAN = "struct<start:int,kind:int,end:int>"
LINK = "struct<start:int,kind:int,end:int,with:struct<start:int,kind:int,end:int>,gap:int>"
#: Matches that one inner fold numbers; keeps the numbering of very many matches from growing with their square.
FOLD = 512


def matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, likely: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, kind, end>>, without those whose group is shorter than least.

    Pieces between matches and the matches themselves alternate, so their lengths give the positions.
    """
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    held = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(held, F.length).alias("held"))
    parts = F.slice(parts, 1, F.size(whole))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["size"]).alias("end"))
        return F.struct((start + x["size"]).alias("at"), F.when(x["held"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    # parts is bound once by a fold over an array of one element
    def bound(_: Column, parts_: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            inner = F.aggregate(F.slice(parts_, i * FOLD + 1, F.lit(FOLD)), F.struct(acc["at"].alias("at"), none.alias("out")), one)
            return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

        blocks = F.sequence(F.lit(0), F.floor((F.size(parts_) - 1) / FOLD).cast("int"))
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start:int,kind:int,end:int>>>)").alias("out"))
        return F.flatten(F.aggregate(blocks, start, step)["out"])

    found = F.aggregate(F.array(parts), none, bound)
    return F.when(text.rlike(pattern) if likely is None else likely, found).otherwise(none)


def parts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (kept columns as k_...) with the strong spans (base), the weak spans (weak), blank lines where links are possible, and row."""
    keep = ["doc_id"] if keep is None else keep
    kept = [F.col(f"k_{i}") for i in range(len(keep))]
    t = F.col("__t")
    df = docs.select(*[quoted(c).alias(f"k_{i}") for i, c in enumerate(keep)], F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("__t"))
    assign = matches(t, ASSIGN, 0, 2, LEAST["assign"])
    access = matches(t, ACCESS, 1, 0, LEAST["access"], t.contains("AKIA"))
    long_hex = matches(t, LONG_HEX, 2, 0, LEAST["hex"], t.rlike("[0-9a-f]{24}"))
    weak_secret = matches(t, WEAK_SECRET, 4, 0, 0, t.rlike(_RUN + "{32}"))
    base = F.array_sort(F.concat(assign, access, long_hex))
    df = df.select(*kept, base.alias("base"), weak_secret.alias("__secret"), "__t")
    # without a secret no other weak part is reported, so none is searched for
    some = F.exists("base", lambda s: s["kind"] != 1) | (F.size("__secret") > 0)
    weak_id, endpoint = matches(t, WEAK_ID, 3, likely=some), matches(t, WEAK_ENDPOINT, 5, likely=some)
    df = df.select(*kept, "base", F.concat(weak_id, "__secret", endpoint).alias("__weak"), "__t")
    # a weak part inside a strong span is no part of its own
    df = df.withColumn("weak", F.filter("__weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))))
    # every link has a secret at one end and something else at the other
    every = F.concat("base", "weak")
    secret = [k for k, p in enumerate(KINDS.values()) if p == "secret"]
    linkable = F.exists(every, lambda s: s["kind"].isin(secret)) & F.exists(every, lambda s: ~s["kind"].isin(secret))
    breaks = F.when(linkable, matches(t, BLANK_LINE, BREAK, 0, 0, t.contains("\n")))
    return df.select(*kept, "base", "weak", breaks.alias("breaks"), F.monotonically_increasing_id().alias("row"))


def linked(found: DataFrame, gap: int = GAP) -> DataFrame:
    """For each row with linkable parts: links, that is each part with its nearest partner of each complementary kind."""
    name = F.element_at(F.array(*[F.lit(p) for p in KINDS.values()]), F.col("part.kind") + 1)
    each = found.where(F.col("breaks").isNotNull()).select("row", F.explode(F.concat("base", "weak", "breaks")).alias("part"))
    each = each.select("row", "part", F.when(F.col("part.kind") < BREAK, name).alias("name"), F.col("part.start").alias("at"), F.col("part.kind").alias("kind"))
    down = Window.partitionBy("row").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("scope", F.sum((F.col("kind") == BREAK).cast("int")).over(down)).where(F.col("kind") < BREAK)
    before = Window.partitionBy("row", "scope").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row", "scope").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    by_end = F.struct(F.col("part.end").alias("end"), F.col("part.start").alias("start"), F.col("part.kind").alias("kind"))
    for p in ("id", "secret", "endpoint"):
        last = F.max(F.when(F.col("name") == p, by_end)).over(before)
        first = F.min(F.when(F.col("name") == p, F.col("part"))).over(behind)
        each = each.withColumn(f"b_{p}", last).withColumn(f"f_{p}", first)
    wanted = {"id": ("secret", "endpoint"), "secret": ("id", "endpoint"), "endpoint": ("id", "secret")}
    near = {}
    for p in wanted:
        # the nearer of the two neighbours; the one before wins a tie
        back, forth = F.col(f"b_{p}"), F.col(f"f_{p}")
        a = F.when(back.isNotNull(), F.greatest(F.lit(0), F.col("at") - back["end"]))
        b = F.when(forth.isNotNull(), F.greatest(F.lit(0), forth["start"] - F.col("part.end")))
        choose = F.when(b.isNull() | (a <= b), F.struct(a.alias("gap"), F.struct(back["start"].alias("start"), back["kind"].alias("kind"), back["end"].alias("end")).alias("with")))
        choose = F.when(a.isNull() & b.isNull(), None).otherwise(choose.otherwise(F.struct(b.alias("gap"), forth.alias("with"))))
        near[p] = F.when(choose["gap"] <= gap, choose)
    each = each.select("row", "part", "name", *[v.alias(f"n_{p}") for p, v in near.items()])
    has = {p: F.col(f"n_{p}").isNotNull() for p in near}
    support = F.when(F.col("name") == "id", has["secret"]).when(F.col("name") == "secret", has["id"] | has["endpoint"]).otherwise(has["id"] & has["secret"])
    partners = [
        F.when((F.col("name") != p) & has[p], F.struct(*[F.col(f"part.{c}").alias(c) for c in ("start", "kind", "end")], F.col(f"n_{p}.with").alias("with"), F.col(f"n_{p}.gap").alias("gap")))
        for p in near
    ]
    each = each.where(support).select("row", "part", F.array_compact(F.array(*partners)).alias("links"))
    weak = F.collect_list(F.when(F.col("part.kind") >= 3, F.col("part")))
    return each.groupBy("row").agg(weak.alias("weak2"), F.array_sort(F.flatten(F.collect_list("links"))).alias("links"))


def listing(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, gap: int = GAP) -> DataFrame:
    """docs (columns keep, default doc_id) with base, all and links.

    base and all: arrays of spans (start, kind as a place in KINDS, end), all with the weak ones that are supported.
    links: array of spans that complementary parts support, each with a partner span (with) and the gap between them.
    """
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ("base", "all", "links")]
    found = materialise(parts(docs, text_col, keep), "secret-parts")  # the text is read and matched once
    cols = [F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)]
    no_spans, no_links = F.expr(f"cast(array() as array<{SPAN}>)"), F.expr(f"cast(array() as array<{LINK}>)")
    some = found.where(F.col("breaks").isNotNull()).drop("weak", "breaks").join(linked(found, gap), "row", "left")
    some = some.select(*cols, "base", F.array_sort(F.concat("base", F.coalesce("weak2", no_spans))).alias("all"), F.coalesce("links", no_links).alias("links"))
    rest = found.where(F.col("breaks").isNull())
    return rest.select(*cols, "base", F.col("base").alias("all"), no_links.alias("links")).unionByName(some)
