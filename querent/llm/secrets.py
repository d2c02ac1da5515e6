r"""Secret scans by a trigram inverted index (native DataFrame operations only).

The index holds every trigram of the lower-cased texts. Documents are numbered as they are scanned, 64 to a block, and
a posting is a trigram, a block, and the set of the block's documents that hold it, as 64 bits; postings are written
once, in the order of trigrams, and serve any rules. Each rule's regular expression gives a Boolean trigram query. A query
reads the postings of the trigrams that it asks for, intersects and unites them block by block, and only the documents left
are verified with the rule's own expression. Rules without a mandatory trigram (runs of hexadecimal digits; parts of
a rule that allow more than ``trigrams.MOST_STRINGS`` strings ask for none) run on every text in the scan that extracts the
trigrams. Spans come from the pieces between matches: a match starts after all earlier pieces and matches, a running
sum over pieces.

Very long texts are cut for the index into pieces of ``PIECE`` characters that overlap by two, so a row holds a
bounded number of trigrams.

Edge cases: a null text counts as empty; a null id is an id like any other; rows with equal id and text share
one verification and each get its result; rows with equal ids and other texts are kept apart by a hash of the
text; an empty table gives no rows; further columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querent.llm.trigrams import trigram_query
from querent.runtime import materialize, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a match counts if its ``group`` has ``least`` characters. Matches don't overlap within a kind."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


#: The first three are the base kinds, in the order in which their spans are listed; the others are added.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = 3
KEY = ("doc_id", "text_hash")
MARK = "[secret]"
PIECE = 50_000


def _matched(rule: Rule, text: Column) -> Column:
    """For each match: length of the piece before it, its own length, whether it counts."""
    # A run of [0-9a-f] that is too short is never part of a longer match, so it needn't be listed.
    java = "[0-9a-f]{24,}" if rule.kind == "hex" else rule.java
    every = F.regexp_extract_all(text, F.lit(java), F.lit(0))
    pieces = F.transform(F.split(text, java, -1), F.char_length)
    lengths = F.transform(every, F.char_length)
    judged = F.transform(F.regexp_extract_all(text, F.lit(java), F.lit(rule.group)), F.char_length) if rule.group else lengths
    rows = F.arrays_zip(F.slice(pieces, 1, F.size(lengths)).alias("piece"), lengths.alias("own"), judged.alias("judged"))
    return F.when(text.rlike(java), rows)


def _asked(rules) -> list[str]:
    return sorted({g for r in rules for clause in trigram_query(r.pattern) for option in clause for g in option})


def _satisfied(rule: Rule, columns: dict[str, Column]) -> Column:
    """Those of a block's documents that satisfy the rule's Boolean query, from the postings of its trigrams."""
    out = F.lit(-1).cast("long")
    for clause in trigram_query(rule.pattern):
        some = F.lit(0).cast("long")
        for option in sorted(map(sorted, clause)):
            every = F.lit(-1).cast("long")
            for gram in option:
                every = every.bitwiseAND(columns[gram])
            some = some.bitwiseOR(every)
        out = out.bitwiseAND(some)
    return out


def build_index(docs: DataFrame, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(directory, postings). directory: doc_id, text_hash, number and the matches of the rules that scan fully, one row
    per document; postings: gram, block, docs (the bits of the block's documents that hold the trigram)."""
    full = [r for r in rules if not trigram_query(r.pattern)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", F.lower("text").alias("low"), F.monotonically_increasing_id().alias("number"))
    cuts = F.sequence(F.lit(0), F.floor((F.char_length("low") - 3) / F.lit(PIECE)).cast("int"))
    pieces = F.when(F.char_length("low") <= PIECE + 2, F.array("low")).otherwise(F.transform(cuts, lambda i: F.substr(F.col("low"), i * PIECE + 1, F.lit(PIECE + 2))))
    parts = rows.select(*KEY, "number", *[_matched(r, F.col("text")).alias(r.kind) for r in full], F.posexplode(pieces).alias("part", "low"))
    grams = F.array_distinct(F.regexp_extract_all("low", F.lit("(?s)(?=(...))"), F.lit(1)))
    # What is scanned is stored, so that numbers stay what they are.
    scanned = materialize(parts.select(*KEY, "number", "part", *[F.when(F.col("part") == 0, F.col(r.kind)).alias(r.kind) for r in full], grams.alias("grams")), "secret-grams")
    bit = F.expr("shiftleft(1L, cast(number & 63 as int))")
    each = scanned.select(F.shiftright("number", 6).alias("block"), bit.alias("bit"), F.explode("grams").alias("gram"))
    postings = each.groupBy("gram", "block").agg(F.bit_or("bit").alias("docs")).sortWithinPartitions("gram", "block")
    return scanned.filter("part = 0").drop("part", "grams"), materialize(postings, "secret-postings")


def candidates(directory: DataFrame, postings: DataFrame, rules=RULES) -> DataFrame:
    """The Boolean queries on the postings: (doc_id, text_hash, one Boolean column for each rule that has a query)."""
    asked = [r for r in rules if trigram_query(r.pattern)]
    grams = _asked(rules)
    if not asked:
        return directory.select(*KEY).limit(0)
    # A block has one posting at most for a trigram, so there is nothing to sum.
    lists = postings.filter(F.col("gram").isin(grams)).groupBy("block").agg(*[F.bit_or(F.when(F.col("gram") == g, F.col("docs"))).alias(f"g{i}") for i, g in enumerate(grams)])
    columns = {g: F.coalesce(f"g{i}", F.lit(0).cast("long")) for i, g in enumerate(grams)}
    left = lists.select("block", *[_satisfied(r, columns).alias(r.kind) for r in asked]).filter(" OR ".join(f"{r.kind} <> 0" for r in asked))
    left = materialize(left, "secret-blocks")
    here = directory.select(*KEY, F.shiftright("number", 6).alias("block"), F.expr("cast(number & 63 as int)").alias("slot"))
    flags = here.join(left, "block").select(*KEY, *[(F.expr(f"shiftrightunsigned({r.kind}, slot) & 1") == 1).alias(r.kind) for r in asked])
    return flags.filter(" OR ".join(r.kind for r in asked))


def _spans(matches: DataFrame, rules) -> DataFrame:
    """(doc_id, text_hash, rule, start, end) from columns of ``_matched`` arrays, one for each rule."""
    order = {r.kind: i for i, r in enumerate(RULES)} | {r.kind: len(RULES) + i for i, r in enumerate(rules) if r not in RULES}
    once = matches.dropDuplicates(list(KEY))
    each = F.explode(F.array(*[F.struct(F.lit(order[r.kind]).alias("rule"), F.lit(r.least).alias("least"), F.col(r.kind).alias("found")) for r in rules]))
    out = once.select(*KEY, each.alias("r")).filter("r.found IS NOT NULL").select(*KEY, "r.rule", "r.least", F.posexplode("r.found").alias("at", "m"))
    before = Window.partitionBy(*KEY, "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.piece") + F.col("m.own")).over(before)
    return out.select(*KEY, "rule", "least", "m.judged", (end - F.col("m.own")).alias("start"), end.alias("end")).filter("judged >= least").select(*KEY, "rule", "start", "end")


def scan(docs: DataFrame, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(keys, spans): every row's (doc_id, text_hash), and the spans (doc_id, text_hash, rule, start, end);
    positions are code points, ``end`` is exclusive, ``rule`` numbers ``rules``."""
    directory, postings = build_index(docs, rules)
    full = [r for r in rules if not trigram_query(r.pattern)]
    asked = [r for r in rules if trigram_query(r.pattern)]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").alias("d")
    # As a table of known size, candidates are broadcast if they are few, and texts are shuffled only if they aren't.
    # Rows that repeat share one candidate.
    chosen = materialize(candidates(directory, postings, rules).distinct(), "secret-candidates").alias("c")
    same = F.expr("d.doc_id <=> c.doc_id AND d.text_hash = c.text_hash")
    verified = texts.join(chosen, same).select("d.doc_id", "d.text_hash", *[F.when(F.col(f"c.{r.kind}"), _matched(r, F.col("d.text"))).alias(r.kind) for r in asked])
    spans = _spans(verified, asked)
    if full:
        some = directory.filter(" OR ".join(f"{r.kind} IS NOT NULL" for r in full))
        spans = spans.unionByName(_spans(some, full))
    return directory.select(*KEY), spans


def _listed(spans: DataFrame, rules=RULES) -> DataFrame:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    counts = [F.count_if(F.col("rule") == i).alias(f"n_{rules[i].kind}") for i in range(BASE)]
    rows = F.array_sort(F.collect_list(F.struct("start", "rule", "end")))
    by = spans.groupBy(*KEY).agg(rows.alias("s"), *counts)
    said = lambda x: F.concat_ws(":", F.element_at(kinds, x["rule"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    base = F.array_join(F.transform(F.filter("s", lambda x: x["rule"] < BASE), said), ",")
    return by.select(*KEY, *[f"n_{r.kind}" for r in rules[:BASE]], base.alias("base"), F.array_join(F.transform("s", said), ",").alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document."""
    keys, spans = scan(table(spark, sf_dir, "documents"))
    out = keys.alias("k").join(_listed(spans).alias("s"), F.expr("k.doc_id <=> s.doc_id AND k.text_hash = s.text_hash"), "left")
    counts = [F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in RULES[:BASE]]
    text = lambda c: F.coalesce(c, F.lit(""))
    return out.select("k.doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def redact(docs: DataFrame, rules=RULES, mark: str = MARK) -> DataFrame:
    """``docs`` with the text of every span, overlapping ones as one, replaced by ``mark``; other rows unchanged."""
    _, spans = scan(docs, rules)
    run = Window.partitionBy(*KEY).orderBy("start", "rule").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("from", F.coalesce(F.max("end").over(run), F.lit(0).cast("long")))
    rows = F.array_sort(F.collect_list(F.struct("start", "rule", "from", "end")))
    by = materialize(spans.groupBy(*KEY).agg(rows.alias("s"), F.max("end").alias("last")), "secret-spans").alias("s")
    own = "text_hash"
    while own in docs.columns:
        own += "_"
    left = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit("")))).alias("d")
    joined = left.join(by, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col(f"d.{own}") == F.col("s.text_hash")), "left")
    text = F.col("d.text")
    # A span that starts inside what has been cut already adds no mark.
    kept = F.transform("s.s", lambda x: F.when((x["start"] >= x["from"]), F.concat(F.substr(text, (x["from"] + 1).cast("int"), (x["start"] - x["from"]).cast("int")), F.lit(mark))).otherwise(F.lit("")))
    clean = F.concat(F.array_join(kept, ""), F.substr(text, (F.col("s.last") + 1).cast("int")))
    new = F.when(F.col("s.s").isNotNull(), clean).otherwise(text)
    return joined.select(*[(new if c == "text" else F.col(f"d.`{c}`")).alias(c) for c in docs.columns])
