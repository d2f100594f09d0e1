"""Personal data: base patterns plus bootstrapped contextual extraction (DataFrame functions only).

*Base.* Four kinds by regular expression with checks (octets, Luhn, digit counts). A text is split at the
matches; positions are running sums of piece lengths in code points, summed in chunks of about the square root of the number
of matches, so that a text of n matches takes n ** 1.5 steps. The expressions are written with possessive loops and look-behind
so that each text is scanned in linear time; they match exactly what the plain forms match.

*Contexts.* Instances are the base entities and identifier-like tokens (a digit, ``@`` or ``_`` in them, white space around, outer
punctuation left out). An occurrence has four lexical patterns: the two words before it, the one word before, the one word after, the
two words after, lower-cased and with digits masked. Words are sought within 256 code points; a pattern with a longer
word does not exist.

*Bootstrap.* Seeds are instances that are base entities of a kind, and free tokens that look like a hexadecimal secret of at
least 32 lower-case digits (kind ``secret``). Over the graph of distinct (pattern, instance) edges Spark iterates: a pattern's
confidence for a kind is the sum of its instances' scores over their number plus a prior, so that instances of other kinds and
of none count against it; an instance that is no seed gets the best confidence of its patterns. Patterns whose instances could be of one kind by chance have
none: the more patterns a corpus has, the more instances each needs (:func:`beyond_chance`). After ``rounds`` the patterns with confidence of at least ``least`` give their free tokens the kind (ties: the
kind listed first; a token with several patterns: the most confident one). Found tokens are added as spans of that kind; base spans
always stay, and what overlaps them is never added.

Defined results: a null text is empty and has no spans; repeated rows each get their spans (copies of a row add
nothing to the graph, whose edges are distinct); a null doc_id stays null; texts of any length are read whole. Empty tables give empty
results. Other columns are never looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.llm._common import kept, small, stored, table

KINDS = ("email", "ip", "card", "phone")
ADDED = (*KINDS, "secret")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<!\S)(?=[^\s0-9@_]*+[0-9@_])\S++"
SECRET = r"^(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,64}$"
NEAR = 256
SPAN = "array<struct<s:int,e:int,m:string,before:string,after:string>>"
BASE = "array<struct<kind:int,s:int,e:int,m:string,before:string,after:string>>"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often a lambda refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _starts(pieces: Column, matches: Column) -> Column:
    """Start of each match, from the pieces between them: running sums in chunks."""
    steps = F.zip_with(F.transform(pieces, F.length), F.transform(matches, F.length), lambda gap, m: F.struct(gap.alias("gap"), F.coalesce(m, F.lit(0)).alias("m")))
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))

    def cut(steps: Column) -> Column:
        c = F.ceil(F.sqrt(F.size(steps))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(steps) / c).cast("int") - 1), lambda k: F.slice(steps, k * c + 1, c))

    def summed(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda ch: F.aggregate(ch, F.lit(0), lambda a, x: a + x["gap"] + x["m"]))
        first = F.aggregate(sums, start(F.lit(0)), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

        def within(ch: Column, at: Column) -> Column:
            step = lambda a, x: F.struct((a["at"] + x["gap"] + x["m"]).alias("at"), F.concat(a["out"], F.array(a["at"] + x["gap"])).alias("out"))
            return F.aggregate(ch, start(at), step, lambda a: a["out"])

        return F.flatten(F.zip_with(chunks, first, within))

    return _bound(steps, lambda x: _bound(cut(x), summed))


def located(text: Column, pattern: str) -> Column:
    """All leftmost matches with start and end in code points and up to 256 code points before and after: (s, e, m, before, after)."""

    def around(x: Column, starts: Column, i: Column) -> Column:
        piece = lambda k: F.coalesce(F.get(x["p"], i + k), F.lit(""))
        match = lambda k: F.coalesce(F.get(x["m"], i + k), F.lit(""))
        s = F.get(starts, i)
        before = F.right(F.concat(F.right(piece(-1), F.lit(NEAR)), match(-1), F.right(piece(0), F.lit(NEAR))), F.lit(NEAR))
        after = F.left(F.concat(F.left(piece(1), F.lit(NEAR)), match(1), F.left(piece(2), F.lit(NEAR))), F.lit(NEAR))
        return F.struct(s.alias("s"), (s + F.length(match(0))).alias("e"), match(0).alias("m"), before.alias("before"), after.alias("after"))

    def found(x: Column) -> Column:
        some = _bound(_starts(x["p"], x["m"]), lambda st: F.transform(F.sequence(F.lit(0), F.size(x["m"]) - 1), lambda i: around(x, st, i)))
        return F.when(F.size(x["m"]) > 0, some).otherwise(F.array().cast(SPAN))

    both = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return _bound(both, found)


def _octets(m: Column) -> Column:
    short = F.transform(F.split(m, r"\.", -1), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(F.length(p) <= 3, p).try_cast("int"), F.lit(0)) <= 255))


def _luhn(m: Column) -> Column:
    digits = F.reverse(F.regexp_replace(m, r"[\x20-]", ""))
    n = F.length(digits)

    def add(a: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        return a + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    total = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(19))), F.lit(0), add)
    return (n >= 13) & (n <= 19) & (total % 10 == 0)


def _digits(m: Column) -> Column:
    n = F.length(F.regexp_replace(m, "[^0-9]", ""))
    return (n >= 9) & (n <= 15)


def base_spans(text: Column) -> Column:
    """Array of (kind, s, e, m) of all base entities, by kind as listed and start."""
    rules = (
        ("email", text.contains("@"), EMAIL, lambda m: F.lit(True)),
        ("ip", text.rlike(r"[0-9]\.[0-9]"), IP, _octets),
        ("card", text.rlike(r"[0-9][\x20-]?[0-9]"), CARD, _luhn),
        ("phone", text.contains("+"), PHONE, _digits),
    )
    none = F.array().cast(BASE)

    def found(number: int, quick: Column, pattern: str, good) -> Column:
        matches = F.filter(located(text, pattern), lambda x: good(x["m"]))
        spans = F.transform(matches, lambda x: F.struct(F.lit(number).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")))
        return F.when(quick, spans.cast(BASE)).otherwise(none)

    return F.concat(*[found(k, quick, pattern, good) for k, (_, quick, pattern, good) in enumerate(rules)])


def occurrences(docs: DataFrame) -> DataFrame:
    """Kept rows (rid, doc_id, base, tokens): base spans and identifier-like tokens of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text.alias("text"), text.rlike("[0-9@_]").alias("any"))
    rows = rows.select("rid", "doc_id", "text", F.when(F.col("any"), base_spans(F.col("text"))).otherwise(F.array().cast(BASE)).alias("base"), F.when(F.col("any"), located(F.col("text"), TOKEN)).otherwise(F.array().cast(SPAN)).alias("tokens"))

    def contexts(x: Column) -> Column:
        """The lexical patterns of an occurrence."""
        masked = lambda words: F.regexp_replace(F.lower(F.regexp_replace(words, r"\s+", " ")), "[0-9]+", "#")
        forms = (("<<", "before", r"(?:^|\s)(\S+\s+\S+)\s*$"), ("<", "before", r"(?:^|\s)(\S+)\s*$"), (">", "after", r"^\s*(\S+)(?:\s|$)"), (">>", "after", r"^\s*(\S+\s+\S+)(?:\s|$)"))
        # A word that the window cuts off is none: the window is longer than its words then.
        listed = [(mark, F.when(F.length(F.regexp_extract(x[side], form, 0)) < NEAR, F.regexp_extract(x[side], form, 1)).otherwise("")) for mark, side, form in forms]
        return F.filter(F.array(*[F.when(words != "", F.concat(F.lit(mark + " "), masked(words))) for mark, words in listed]), lambda c: c.isNotNull())

    def trimmed(x: Column) -> Column:
        """The token without outer punctuation; its span moves accordingly."""
        lead = F.length(F.regexp_extract(x["m"], r"^[^\p{L}\p{N}]*", 0))
        core = F.regexp_replace(F.substring(x["m"], lead + 1, F.length(x["m"])), r"[^\p{L}\p{N}]+$", "")
        return F.struct((x["s"] + lead).alias("s"), (x["s"] + lead + F.length(core)).alias("e"), core.alias("m"), contexts(x).alias("contexts"))

    base = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), contexts(x).alias("contexts")))
    return kept(rows.select("rid", "doc_id", base.alias("base"), F.transform("tokens", trimmed).alias("tokens")))


def _free_tokens(seen: DataFrame) -> DataFrame:
    """(rid, s, e, m, seed, contexts) of tokens that overlap no base span: both are put in order within their text and compared with the spans beside them."""
    base = seen.select("rid", F.inline("base")).select("rid", F.lit(True).alias("is_base"), "s", "e", "m", "contexts")
    tokens = seen.where(F.size("tokens") > 0).select("rid", F.inline("tokens")).select("rid", F.lit(False).alias("is_base"), "s", "e", "m", "contexts")
    so_far = lambda *order: Window.partitionBy("rid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("is_base"), F.col("e"))).over(so_far("s", "is_base"))
    # backwards, as a frame that begins at each row would be gone through again for each row
    ahead = F.min(F.when(F.col("is_base"), F.col("s"))).over(so_far(F.desc("s"), F.desc("is_base")))
    placed = base.union(tokens.where("m <> ''")).select("*", reach.alias("reach"), ahead.alias("ahead"))
    free = placed.where("not is_base and (reach is null or reach <= s) and (ahead is null or ahead >= e)")
    return free.select("rid", "s", "e", "m", F.when(F.col("m").rlike(SECRET), len(KINDS)).cast("int").alias("seed"), "contexts")


def beyond_chance(hits: Column, n: Column, rate: float, n_patterns: int, alpha: float) -> Column:
    """Whether none of ``n_patterns`` patterns is likely to have so many hits among n instances by chance, each with the given rate.

    Chernoff's bound of the binomial tail, exp(-n KL(hits / n || rate)), times the number of patterns is at most ``alpha``; so the more patterns a corpus has the more instances
    each one needs.
    """
    p = hits / n
    miss = F.when(hits < n, (n - hits) * F.log((1 - p) / F.lit(1 - rate))).otherwise(0.0)
    return (p > rate) & (hits * F.log(p / F.lit(rate)) + miss >= math.log(max(n_patterns, 1) / alpha))


def learn_patterns(seen: DataFrame, free: DataFrame, rounds: int = 3, least: float = 0.8, prior: float = 0.5, alpha: float = 0.01) -> DataFrame:
    """Stored (context, kind, confidence) of the patterns trusted after the last round.

    In each round only patterns whose instances are of one kind :func:`beyond_chance` have a confidence; a kind's rate is its share of all (pattern, seed or free instance) pairs.
    """
    seeds = seen.select(F.inline("base")).select("contexts", "m", F.col("kind").alias("seed"))
    edges = seeds.union(free.select("contexts", "m", "seed")).select(F.explode("contexts").alias("context"), F.xxhash64("m").alias("instance"), "seed")
    edges = edges.groupBy("context", "instance").agg(F.min("seed").alias("seed"))
    often = edges.groupBy("context").agg(F.count(F.lit(1)).alias("n"))
    # Patterns with a single instance can never be trusted and lead nowhere.
    edges = stored(edges.join(often.where("n >= 2"), "context"), "pii-edges")
    kinds = range(len(ADDED))
    shares = edges.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("context").alias("p"), *[F.count(F.when(F.col("seed") == k, 1)).alias(f"r{k}") for k in kinds]).first()
    # half a pair more, so that a rate is between 0 and 1
    rates = [(shares[f"r{k}"] + 0.5) / (shares["n"] + 1.0) for k in kinds]
    scores = edges.groupBy("instance").agg(F.min("seed").alias("seed")).select("instance", "seed", *[(F.col("seed") == k).cast("double").alias(f"s{k}") for k in kinds]).fillna(0.0, [f"s{k}" for k in kinds])
    scores = stored(scores, "pii-scores")
    for turn in range(rounds):
        summed = edges.drop("seed").join(scores.drop("seed"), "instance").groupBy("context").agg(F.first("n").alias("n"), *[F.sum(f"s{k}").alias(f"h{k}") for k in kinds])
        real = [beyond_chance(F.col(f"h{k}"), F.col("n"), rates[k], shares["p"], alpha) for k in kinds]
        sure = [F.when(real[k], F.col(f"h{k}") / (F.col("n") + prior)).otherwise(0.0).alias(f"c{k}") for k in kinds]
        patterns = summed.select("context", "n", *sure)
        patterns = stored(patterns.where(F.greatest(*[F.col(f"c{k}") for k in kinds]) > 0), "pii-patterns")
        if turn + 1 < rounds:
            reached = edges.join(patterns.drop("n"), "context").groupBy("instance").agg(*[F.max(f"c{k}").alias(f"b{k}") for k in kinds])
            new = scores.join(reached, "instance", "left")
            scores = stored(new.select("instance", "seed", *[F.when(F.col("seed").isNotNull(), F.col(f"s{k}")).otherwise(F.coalesce(f"b{k}", F.lit(0.0))).alias(f"s{k}") for k in kinds]), "pii-scores")
    best = F.greatest(*[F.col(f"c{k}") for k in kinds])
    kind = F.coalesce(*[F.when(F.col(f"c{k}") == best, F.lit(k)) for k in kinds])
    return stored(patterns.where(best >= least).select("context", kind.alias("kind"), best.alias("confidence")), "pii-trusted")


def find_pii(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, s, e), by kind as listed and start; kind is a number into ADDED."""
    seen = occurrences(docs)
    free = stored(_free_tokens(seen), "pii-free")
    trusted = learn_patterns(seen, free, **options)
    places = free.select("rid", "s", "e", F.explode("contexts").alias("context")).join(small(trusted)(trusted), "context")
    # the most confident pattern decides; on ties the kind listed first
    chosen = places.groupBy("rid", "s", "e").agg(F.min(F.struct((-F.col("confidence")).alias("order"), "kind")).alias("best"))
    added = chosen.groupBy("rid").agg(F.collect_list(F.struct("best.kind", "s", "e")).alias("added"))
    base = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    joined = seen.select("rid", "doc_id", base.alias("base")).join(added, "rid", "left")
    none = F.array().cast("array<struct<kind:int,s:int,e:int>>")
    return joined.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in ADDED])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"], x["e"])), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"))
