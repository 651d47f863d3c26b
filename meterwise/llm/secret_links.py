"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong patterns (assignments, access identifiers, long hex strings) are
reported as they are.  Weak candidates - short or bare secrets, account
identifiers, service endpoints - are reported only when complementary parts
co-occur: every identifier opens a scope of ``scope`` code points around
itself, and an interval join finds the secrets and endpoints that overlap it.

* a weak identifier is reported if a secret (strong or weak) is in its scope;
* a weak secret is reported if it lies in the scope of an identifier;
* an endpoint is reported if it lies in the scope of an identifier that has a
  secret in scope too.

Positions are code points, end exclusive.  Java's regular expressions give the
pieces between matches and the matches; running sums of their lengths (one
window over the matches of a row) give the positions, so a text of any length
costs linear work.  The interval join hashes scopes and parts into cells of
``scope`` code points, so the join key is (row, cell) and one long document is
dealt out over many tasks; a pair meets only in the later of its two first
cells.

Defined cases: a null text is empty; a row is named by its id and a digest of
its text, so repeated rows and null ids get their own results; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import cut, text_key

SCOPE = 256
# Patterns of the base kinds, in listed order
ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# patterns of the weak parts
WEAK_ID = (r"""(?i)(?:access|account|client|user|login)[_-]?(?:key[_-]?)?(?:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=@-]{3,}"""
           r"""|AKIA[A-Z0-9]{4,11}(?![A-Z0-9])""")
WEAK_SECRET = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}"
ENDPOINT = r"""(?i)(?:https?|ftp|ssh|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20"'<>]+"""
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
BASE = KINDS[:3]


def _found(text: Column, order: int, kind: int, pattern: str, keep, needs: str = "") -> Column:
    """array<struct<list, kind, i, gap, len, keep>>: matches with the length of the text before each.

    ``needs`` is a piece that every match holds: texts without it are not decoded."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    one = F.transform(matches, lambda m, i: F.struct(
        F.lit(order).alias("list"), F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("len"), keep(m).alias("keep")))
    return F.when((F.contains(text, F.lit(needs)) & text.rlike(pattern)) if needs else text.rlike(pattern), one)


def _assigned(text: Column) -> Column:
    """Assignments: a value of 8 or more characters is strong, one of 4 to 7 a weak secret."""
    pieces = F.split(text, ASSIGN, -1)
    matches = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))

    def one(m: Column, i: Column) -> Column:
        n = F.length(F.get(values, i))
        return F.struct(F.lit(0).alias("list"), F.when(n >= 8, F.lit(0)).otherwise(F.lit(4)).alias("kind"), i.alias("i"),
                        F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("len"), (n >= 4).alias("keep"))
    return F.when(text.rlike(ASSIGN), F.transform(matches, one))


def parts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every strong or weak part: id, key (digest of the text), kind, start, end."""
    t = F.coalesce(F.col(text_col), F.lit(""))

    def yes(m: Column) -> Column:
        return F.length(m) > 0

    def mixed(m: Column) -> Column:
        return m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]") & ~m.rlike(ACCESS)

    lists = [_assigned(t), _found(t, 1, 1, ACCESS, yes, "AKIA"), _found(t, 2, 2, HEX, yes), _found(t, 3, 3, WEAK_ID, yes),
             _found(t, 4, 4, WEAK_SECRET, mixed), _found(t, 5, 5, ENDPOINT, yes, "://")]
    rows = df.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"),
                     *[x.alias(f"l{g}") for g, x in enumerate(lists)])
    some = F.lit(False)
    for g in range(len(lists)):
        some = some | F.col(f"l{g}").isNotNull()
    none = F.array().cast("array<struct<list:int,kind:int,i:int,gap:int,len:int,keep:boolean>>")
    # lengths only, no text; the lists go through one shuffle together, equal rows once
    rows = (rows.filter(some).select("id", "key", F.concat(*[F.coalesce(f"l{g}", none) for g in range(len(lists))]).alias("found"))
            .groupBy("id", "key").agg(F.first("found").alias("found")))
    w = Window.partitionBy("id", "key", "list").orderBy("i")
    return (rows.select("id", "key", F.explode("found").alias("s")).select("id", "key", "s.*")
            .withColumn("end", F.sum(F.col("gap") + F.col("len")).over(w).cast("long"))
            .filter("keep")
            .select("id", "key", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1).alias("kind"),
                    (F.col("end") - F.col("len")).alias("start"), "end"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The strong parts and those weak parts whose complement is in scope: id, key, kind, start, end."""
    found = cut(found, "secret-parts")
    strong = found.filter(F.col("kind").isin(*BASE))
    ids = (found.filter(F.col("kind").isin("access", "weak_id"))
           .withColumn("lo", F.greatest(F.col("start") - scope, F.lit(0))).withColumn("hi", F.col("end") + scope))
    secrets = found.filter(F.col("kind").isin("assign", "hex", "weak_secret"))
    ends = found.filter(F.col("kind") == "endpoint")

    def celled(df: DataFrame, lo: str, hi: str) -> DataFrame:
        """A row for each cell of ``scope`` code points that [lo, hi) touches; ``first`` is the first."""
        first = F.floor(F.col(lo) / scope)
        return df.withColumn("first", first).withColumn("cell", F.explode(F.sequence(first, F.floor((F.col(hi) - 1) / scope))))

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        """Pairs of a scope of ``a`` and a part of ``b`` that overlap."""
        x = celled(a, "lo", "hi").select("id", "key", "cell", F.struct("kind", "start", "end", "lo", "hi").alias("a"), F.col("first").alias("fa"))
        y = celled(b, "start", "end").select(F.col("id").alias("id_b"), F.col("key").alias("key_b"), F.col("cell").alias("cell_b"),
                                             F.struct("kind", "start", "end").alias("b"), F.col("first").alias("fb"))
        on = F.col("id").eqNullSafe(F.col("id_b")) & (F.col("key") == F.col("key_b")) & (F.col("cell") == F.col("cell_b"))
        return (x.join(y, on).filter((F.col("cell") == F.greatest("fa", "fb")) & (F.col("b.start") < F.col("a.hi")) & (F.col("b.end") > F.col("a.lo")))
                .select("id", "key", "a", "b"))

    def overlapping(part: Column, scope_of: Column) -> Column:
        return (part["start"] < scope_of["end"]) & (part["end"] > scope_of["start"])

    pairs = cut(meet(ids, secrets).filter(~overlapping(F.col("b"), F.col("a")) | (F.col("b.kind") == "assign")), "secret-pairs")
    armed = pairs.select("id", "key", F.col("a.kind").alias("kind"), F.col("a.start").alias("start"), F.col("a.end").alias("end"),
                         F.col("a.lo").alias("lo"), F.col("a.hi").alias("hi")).distinct()
    weak = [armed.filter(F.col("kind") == "weak_id").select(*found.columns),
            pairs.filter(F.col("b.kind") == "weak_secret").select("id", "key", "b.*"),
            meet(armed, ends).select("id", "key", "b.*")]
    out = strong
    for x in weak:
        out = out.unionByName(x.select(*found.columns).distinct())
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """All reported spans of every text: id, key, kind, start, end."""
    return linked(parts(df, id_col, text_col), scope)
