"""Secrets, told apart by who owns them (DataFrame functions only).

Candidates come from patterns: three base kinds (assignments of a password or
key, access key ids, long hex runs) and three more that count only if the
corpus speaks for them (long mixed tokens, private key blocks, passwords in
urls). Every candidate's value is reduced to 16 bytes of its digest, and over
the whole corpus each digest is counted by distinct owner and by distinct
repository. A value that at least ``wide_owners`` owners and
``wide_repositories`` repositories hold has been copied around: an example. A
value of fewer owners that looks random (Shannon entropy, digits, no
placeholder word) is live; any other is weak. Base spans are always reported,
spans of the other kinds only if live.

A digest is counted in three steps, (digest, owner, repository), then (digest,
owner), then digest, each summed before the shuffle, so a secret in a third of
all rows is one row per task. On the way back, digests with at least a
thousandth of all candidates (at most a thousand rows, whatever the corpus) are
broadcast; every other one is small enough for a plain equi-join.

Defined results: a null text is empty and holds nothing; a null owner or
repository is one unknown owner or repository; repeated rows get the same
spans, each for itself, and count as one owner; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import find_all, settled, stash

BASE = ("assign", "access", "hex")
MORE = ("token", "key_block", "url_password")
KINDS = BASE + MORE

# The contract's patterns for the base kinds. Lookbehinds and possessive loops
# only keep the matcher from trying starts and ends that can't match.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
URL_PASSWORD = r"[A-Za-z]{2,12}://[^\x09-\x0D\x20/:@]++:([^\x09-\x0D\x20/@]++)@"
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "token": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
    "key_block": r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[A-Za-z0-9+/=\x09-\x0D\x20]*+(?:-----END [A-Z0-9 ]*PRIVATE KEY-----)?",
    "url_password": URL_PASSWORD,
}
GUARDS = {"access": "AKIA", "key_block": "PRIVATE KEY-----", "url_password": "://"}
PLACEHOLDER = r"(?i)example|sample|change.?me|your[_-]|placeholder|dummy|x{6}|0{8}|123456|redacted"
UUID = r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: Least bits a character, and characters, of a value that looks random.
BITS, LENGTH = 2.5, 8
WIDE, HOT = 3, 1000

SPAN = "array<struct<kind:string,start:bigint,end:bigint,secret:binary,random:boolean>>"


def entropy(value: Column) -> Column:
    """Shannon entropy of a string, in bits a character."""
    n = F.length(value).cast("double")

    def add(acc: Column, c: Column) -> Column:
        p = (n - F.length(F.replace(value, c, F.lit("")))) / n
        return acc - p * F.log2(p)

    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), lambda acc, c: F.when(c == "", acc).otherwise(add(acc, c)))).otherwise(F.lit(0.0))


def _value(kind: str, x: Column) -> Column:
    """What is secret about a match."""
    if kind == "assign":
        return F.regexp_extract(x, ASSIGN, 1)
    if kind == "url_password":
        return F.regexp_extract(x, URL_PASSWORD, 1)
    if kind == "key_block":
        return F.regexp_replace(x, r"-----[A-Z0-9 ]+-----|[\x09-\x0D\x20]", "")
    return x


def _counts(kind: str, x: Column) -> Column:
    """Whether a match counts as a candidate."""
    if kind == "assign":
        return F.length(_value(kind, x)) >= 6
    if kind == "token":
        return (F.length(F.regexp_replace(x, "[^0-9]", "")) >= 3) & (F.length(F.regexp_replace(x, "[^A-Za-z]", "")) >= 3) & (entropy(x) >= 3.2) & ~x.rlike(UUID)
    return F.lit(True)


def _random(value: Column) -> Column:
    return (F.length(value) >= LENGTH) & value.rlike("[0-9]") & ~value.rlike(PLACEHOLDER) & (entropy(value) >= BITS)


def candidates(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``text``) and ``_found``, its candidates of all kinds."""
    out = settled(find_all(rows, PATTERNS, GUARDS), *[f"_f_{k}" for k in KINDS])

    def of(kind: str) -> Column:
        good = F.filter(f"_f_{kind}", lambda s: _counts(kind, s["value"]))
        made = F.transform(good, lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.substring(F.unhex(F.sha2(_value(kind, s["value"]), 256)), 1, 16).alias("secret"), _random(_value(kind, s["value"])).alias("random")))
        return F.coalesce(made, F.array().cast(SPAN))

    return settled(out.withColumn("_found", F.concat(*[of(k) for k in KINDS])).drop(*[f"_f_{k}" for k in KINDS]), "_found")


def ownership(found: DataFrame) -> DataFrame:
    """(secret, n, repositories, owners) of every distinct value in a frame
    with one row per candidate (secret, owner, repository)."""
    by_repository = found.groupBy("secret", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("secret", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("secret").agg(F.sum("n").alias("n"), F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def _order(kind: str) -> Column:
    out = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        out = F.when(F.col(kind) == k, i).otherwise(out)
    return out


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), wide_owners: int = WIDE, wide_repositories: int = WIDE) -> DataFrame:
    """(doc_id, found) of every row: ``found`` lists the spans (start, end,
    kind, verdict, owners, repositories, n), by start and then by kind. The
    columns named say who owns a row and what repository it is part of."""
    named = F.array_join(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in repository]), "\x00")
    rows = docs.select(
        F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(f"`{owner}`").cast("string"), F.lit("")).alias("owner"), named.alias("repository"), F.monotonically_increasing_id().alias("_row"))
    kept = stash(candidates(rows).drop("text"), "secret-candidates")
    each = kept.where(F.size("_found") > 0).select("_row", "owner", "repository", F.explode("_found").alias("s")).select("_row", "owner", "repository", "s.*")
    owned = stash(ownership(each), "secret-owners")
    total = owned.agg(F.sum("n")).first()[0] or 0
    # at most HOT rows can pass this bound, whatever the corpus
    hot = owned.where(F.col("n") * HOT >= total)
    plain = each.drop("owner", "repository")
    judged = plain.join(F.broadcast(hot), "secret").unionByName(
        plain.join(F.broadcast(hot.select("secret")), "secret", "left_anti").join(owned.where(F.col("n") * HOT < total), "secret"))
    copied = (F.col("owners") >= wide_owners) & (F.col("repositories") >= wide_repositories)
    judged = judged.withColumn("verdict", F.when(copied, "example").when(F.col("random"), "live").otherwise("weak")).withColumn("order", _order("kind"))
    # a span of the other kinds must not touch a base span of its text
    base = F.col("order") < len(BASE)
    before = Window.partitionBy("_row").orderBy("start", "order").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_row").orderBy(F.col("start").desc(), F.col("order").desc()).rowsBetween(Window.unboundedPreceding, -1)
    judged = judged.withColumn("_end", F.max(F.when(base, F.col("end"))).over(before)).withColumn("_next", F.min(F.when(base, F.col("start"))).over(after))
    clear = (F.coalesce("_end", "start") <= F.col("start")) & (F.coalesce("_next", "end") >= F.col("end"))
    shown = judged.where(base | (clear & (F.col("verdict") == "live")))
    span = F.struct("start", "order", "end", "kind", "verdict", "owners", "repositories", "n")
    listed = shown.groupBy("_row").agg(F.sort_array(F.collect_list(span)).alias("found"))
    none = listed.schema["found"].dataType
    with_some = kept.where(F.size("_found") > 0).select("_row", "doc_id").join(listed, "_row", "left").select("doc_id", F.coalesce("found", F.array().cast(none)).alias("found"))
    return kept.where(F.size("_found") == 0).select("doc_id", F.array().cast(none).alias("found")).unionByName(with_some)


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
