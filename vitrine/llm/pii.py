"""Personal data and the terms that disclose it (DataFrame functions only).

Base spans come from four patterns. The information-theoretic part follows the
idea of C-sanitisation: over the whole corpus, count in how many documents a
protected value e occurs, in how many a term t does, and in how many both do,
wherever they stand. PMI(t, e) = log2(N * n_te / (n_t * n_e)), and
IC(e) = log2(N / n_e) is what knowing e itself discloses. A term whose PMI
reaches ``generalise`` (a share of IC) is replaced by a general one, from
``remove`` on it goes altogether. Term and value must meet in at least
``support`` documents of which no two are near copies of each other: copies of
a document are no evidence. Documents are told apart by the SKETCH smallest
hashes of their two-word runs.

All terms of all documents are counted first. PMI can only reach its bound for
a term in at most N (n_e / N) ** generalise documents, and values need
``support`` documents too, so frequent terms and rare values and terms are left
out before values and terms meet, by an equi-join on the document.

Defined results: a null text is empty and has no spans; repeated rows get the
same spans, each for itself; an empty table gives an empty result; of other
columns only the names given are read. Where spans overlap, ``sanitise`` puts
one sign, that of the first, in the place of all they cover together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import find_all, running, settled, stash, texts, window_hashes

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns. Lookbehinds and possessive loops only keep the
# matcher from trying starts that can't match; the matches are the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # whole runs of 16 to 19 digits: shorter and longer runs are matches too, which the digit count drops
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GUARDS = {"email": "@", "phone": "+"}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"\p{L}{3,}"
#: Hashes that stand for a document, their common share from which two are near copies, and documents compared in one go.
SKETCH, COPY, TOGETHER = 16, 0.5, 256
#: Bytes of the documents' lists of disclosing terms up to which they are broadcast.
OWN_BYTES = 16 << 20
#: Code points of the pieces a text is cut into before spans are replaced.
PIECE = 4096

SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def luhn(digits: Column) -> Column:
    """The check sum of a string of 16 to 19 digits is a multiple of ten."""
    back, total = F.reverse(digits), F.lit(0)
    for i in range(19):
        d = F.coalesce(F.nullif(F.substring(back, i + 1, 1), F.lit("")).cast("int"), F.lit(0))
        total = total + (F.when(d >= 5, 2 * d - 9).otherwise(2 * d) if i % 2 else d)
    return total % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    if kind == "ip":
        return x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _spans(found: str, kind: str) -> Column:
    """Structs of the matches in a column of :func:`find_all`."""
    made = F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    return F.coalesce(made, F.array().cast(SPAN))


def base_spans(rows: DataFrame) -> DataFrame:
    """Adds ``_spans`` to a frame with a ``text`` column."""
    out = find_all(rows, PATTERNS, GUARDS)
    good = [_good(k) for k in KINDS]
    return settled(out.withColumn("_spans", F.concat(*good)).drop(*[f"_f_{k}" for k in KINDS]), "_spans")


def _good(kind: str) -> Column:
    return F.filter(_spans(f"_f_{kind}", kind), lambda s: _valid(kind, s["value"]))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _entity(s: Column) -> Column:
    plain = F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(F.regexp_replace(s["value"], "[^0-9]", ""))
    return F.concat_ws(":", s["kind"], plain)


def _supported(near_by: DataFrame, pairs: DataFrame, support: int) -> DataFrame:
    """(e, term) with ``support`` surroundings no two of which are near copies.
    In rounds, groups of about TOGETHER surroundings of a pair keep up to
    ``support`` that differ from each other, however often the entity occurs."""
    left = stash(near_by.join(pairs.where(F.col("kinds") >= support).select("e", "term", "kinds"), ["e", "term"]).select("e", "term", "around", "kinds"), "pii-around")
    close = lambda a, b: F.size(F.array_intersect(a, b)) * (1 + COPY) >= COPY * (F.size(a) + F.size(b))

    def add(acc: Column, x: Column) -> Column:
        return F.when((F.size(acc) >= support) | F.exists(acc, lambda a: close(a, x)), acc).otherwise(F.concat(acc, F.array(x)))

    together = max(TOGETHER, 4 * support)  # so each round leaves at most about a quarter
    while True:
        most = left.agg(F.max("kinds")).first()[0] or 0
        groups = F.ceil(F.col("kinds") / together)
        some = left.groupBy("e", "term", F.pmod(F.xxhash64("around"), groups).alias("part")).agg(F.sort_array(F.collect_list("around")).alias("all"))
        kept = settled(some.withColumn("kept", F.aggregate("all", F.array().cast("array<array<bigint>>"), add)), "kept").drop("all", "part")
        if most <= together:
            return kept.where(F.size("kept") >= support).select("e", "term")
        left = kept.select("e", "term", F.explode("kept").alias("around"))
        sizes = left.groupBy("e", "term").agg(F.count(F.lit(1)).alias("kinds"))
        left = stash(left.join(sizes, ["e", "term"]), "pii-around")


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _evidence(rows: DataFrame) -> DataFrame:
    """(_doc, entities, around, terms) of the rows with spans: ``around`` is
    the sketch that tells documents apart, protected values are no terms."""
    mask = "|".join(f"(?:{p.replace(chr(92) + 'G', '^')})" for p in PATTERNS.values())
    some = rows.where(F.size("_spans") > 0).select(
        F.monotonically_increasing_id().alias("_doc"), F.array_distinct(F.transform("_spans", _entity)).alias("entities"),
        F.regexp_extract_all(F.lower(F.regexp_replace("text", mask, " ")), F.lit(TERM), F.lit(0)).alias("_w"))
    some = settled(some, "entities", "_w")
    some = settled(some.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))), "_h")
    runs = F.when(F.size("_h") < 2, F.array(F.xxhash64("_h"))).otherwise(window_hashes("_h", 2))
    return some.select("_doc", "entities", F.slice(F.sort_array(F.array_distinct(runs)), 1, SKETCH).alias("around"), F.array_distinct("_w").alias("terms"))


def disclosing_terms(found: DataFrame, docs: DataFrame, generalise: float = 0.9, remove: float = 0.97, support: int = 3) -> DataFrame | None:
    """(term, action, ratio) over a threshold, or None if there are none.

    ``found`` has the texts with their ``_spans``, ``docs`` the texts of all
    documents; counts are over all of them."""
    held = stash(_evidence(found), "pii-evidence")
    counted = stash(docs.select(_terms(F.col("text")).alias("t")).select(F.explode("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).where(F.col("n_t") >= support), "pii-terms")
    total = float(docs.count())
    each = held.select("_doc", "around", F.explode("entities").alias("e"))
    # copies of one document share a sketch: only values with enough sketches can have terms
    by_sketch = each.groupBy("e", "around").agg(F.count(F.lit(1)).alias("n"))
    values = stash(by_sketch.groupBy("e").agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("sketches")).where(F.col("sketches") >= support), "pii-values")
    most = values.agg(F.max("n_e")).first()[0]
    if most is None:
        return None
    reach = lambda n: F.lit(total) * F.pow(n / F.lit(total), F.lit(generalise)) * (1 + 1e-9)
    rare = counted.where(F.col("n_t") <= reach(F.lit(float(most))))
    own = each.join(values.select("e", "n_e"), "e").groupBy("_doc").agg(F.collect_list(F.struct("e", "n_e")).alias("es"))
    held = stash(held.select("_doc", "around", "terms").join(own, "_doc"), "pii-held")
    # thin counts first; the sketches only for the pairs whose ratio is high enough
    met = held.select("es", F.explode("terms").alias("term")).join(rare, "term").select("term", "n_t", F.explode("es").alias("_e"))
    met = met.select("_e.e", "_e.n_e", "term", "n_t").where(F.col("n_t") <= reach(F.col("n_e")))
    pairs = met.groupBy("e", "n_e", "term", "n_t").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= support)
    ic = F.log2(F.lit(total) / F.col("n_e"))
    pmi = F.log2(F.lit(total) * F.least("n_te", "n_t") / (F.col("n_t") * F.col("n_e")))
    likely = stash(pairs.withColumn("ratio", F.when(ic > 0, pmi / ic)).where(F.col("ratio") >= generalise), "pii-likely")
    near_by = held.select("around", "es.e", F.explode("terms").alias("term")).join(likely.select("term").distinct(), "term")
    near_by = near_by.select("term", "around", F.explode("e").alias("e")).join(likely.select("e", "term"), ["e", "term"])
    near_by = stash(near_by.select("e", "term", "around").distinct(), "pii-pairs")
    kinds = near_by.groupBy("e", "term").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") >= support)
    pairs = likely.select("e", "term", "ratio").join(kinds, ["e", "term"])
    told = _supported(near_by, pairs, support)
    out = pairs.join(told, ["e", "term"]).groupBy("term").agg(F.max("ratio").alias("ratio"))
    out = stash(out.withColumn("action", F.when(F.col("ratio") >= remove, "remove").otherwise("generalise")), "pii-disclosing")
    return None if out.isEmpty() else out


def _term_spans(rows: DataFrame, terms: DataFrame | None) -> DataFrame:
    """Adds ``_terms``: spans of disclosing terms outside the base spans. Rows
    meet their terms by the text's digest, so repeated rows need no id."""
    none = F.array().cast(SPAN)
    if terms is None:
        return rows.withColumn("_terms", none)
    each = rows.select("text").withColumn("_sha", F.sha2("text", 256))
    held = each.select("_sha", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    own = held.join(terms, "term").groupBy("_sha").agg(F.sort_array(F.collect_set(F.struct("term", "action"))).alias("_own"))
    own = stash(own, "pii-own")
    size = own.agg(F.sum(F.lit(96) + F.aggregate("_own", F.lit(0), lambda n, o: n + F.octet_length(o["term"]) + 48))).first()[0] or 0
    # small lists go to the texts; the texts are shuffled to them only beyond the bound
    small = F.broadcast(own) if size <= OWN_BYTES else own
    out = rows.withColumn("_sha", F.sha2("text", 256)).join(small, "_sha", "left")
    out = out.withColumn("_re", F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.col("_own.term"), "|"), F.lit(r")(?!\p{L})")))
    out = find_all(out, {"term": F.col("_re")})
    out = settled(out.withColumn("_placed", _spans("_f_term", "term")), "_placed")
    clear = F.filter("_placed", lambda s: ~F.exists("_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.withColumn("_terms", clear).drop("_sha", "_re", "_f_term", "_placed")


def find_pii(docs: DataFrame, generalise: float = 0.9, remove: float = 0.97, support: int = 3) -> DataFrame:
    """(doc_id, _spans, _terms) of every row, as arrays of spans."""
    rows = texts(docs)
    found = stash(base_spans(rows), "pii-base")
    terms = disclosing_terms(found, found.select("text"), generalise, remove, support)
    return _term_spans(found, terms).select("doc_id", "_spans", "_terms")


def sanitise(docs: DataFrame, generalise: float = 0.9, remove: float = 0.97, support: int = 3) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by [EMAIL], [IP],
    [CARD], [PHONE] and disclosing terms by [TERM] or nothing; a null text
    stays null, other columns stay as they are."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = stash(base_spans(own), "pii-base")
    terms = disclosing_terms(found, found.select("text"), generalise, remove, support)
    marked = _term_spans(found, terms)
    if "_own" not in marked.columns:
        marked = marked.withColumn("_own", F.lit(None).cast("array<struct<term:string,action:string>>"))
    gone = F.transform(F.filter("_own", lambda o: o["action"] == "remove"), lambda o: o["term"])
    sign = lambda s: F.when((s["kind"] == "term") & F.coalesce(F.array_contains(gone, F.lower(s["value"])), F.lit(False)), "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    spans = F.sort_array(F.transform(F.concat("_spans", "_terms"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), sign(s).alias("sign"))))
    marked = settled(marked.withColumn("_all", spans).withColumn("_blocks", F.when(F.size("_all") > 0, _blocks(F.col("text")))).drop("_spans", "_terms", "_own"), "_all", "_blocks")
    # how far the spans up to each one reach: those that start within that reach are covered
    marked = settled(marked.withColumn("_ends", F.transform("_all", lambda s: s["end"])), "_ends")
    marked = settled(marked.withColumn("_reach", running("_ends", lambda a, x: F.greatest(a, x))), "_reach")
    reach = lambda i: F.coalesce(F.get("_reach", i - 1), F.lit(0))
    put = F.transform("_all", lambda s, i: F.when(s["start"] >= reach(i), F.concat(_cut(reach(i), s["start"]), s["sign"])).otherwise(""))
    clean = F.concat(F.array_join(put, ""), _cut(reach(F.size("_all")), F.length("text").cast("bigint")))
    new = F.when(F.col("_doc.text").isNull(), F.lit(None).cast("string")).when(F.size("_all") == 0, F.col("text")).otherwise(clean)
    return marked.select(*[(new if c == "text" else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def _blocks(text: Column) -> Column:
    """A text in pieces of PIECE code points: a substring of a long text would
    be searched for from its first character every time."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE)))


def _cut(start: Column, end: Column) -> Column:
    """Code points start to end of the text in ``_blocks``."""
    a, b = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    first, last = (start - a * PIECE).cast("int"), (end - b * PIECE).cast("int")
    one = F.substring(F.get("_blocks", a), first + 1, last - first)
    more = F.concat(F.substring(F.get("_blocks", a), first + 1, F.lit(PIECE)), F.array_join(F.slice("_blocks", a + 2, b - a - 1), ""), F.substring(F.get("_blocks", b), F.lit(1), last))
    return F.when(end <= start, "").when(a == b, one).otherwise(more)
