"""Reports over runs, samples and plans."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

#: Literals that are looked for in one pass, where they have no whole word to look them up by.
LITERALS = 10_000
#: Quantiles that a sketch names, its accuracy, samples that are counted one by one, and ranks whose borders may be sent to each executor.
STEPS, ACCURACY, FEW, BROADCAST = 100, 1000, 50_000, 10_000


def _inside(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The samples strictly between the borders (low, high) of wanted, a row for each of its names; no border is open."""
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
    return rows.join(few, keys).where("(low IS NULL OR sample > low) AND (high IS NULL OR sample < high)")


def _of_rank(samples: DataFrame, keys: list[str], ranks: dict[str, Column]) -> DataFrame:
    """keys, n, and for each name the sample of a rank (from zero, an expression of n) in each group's order.

    A mergeable quantile sketch names two samples around a rank, and exact counts tell on which
    side of them, on one of them, or between them it stands. That is done again within what
    is left until FEW samples are, whatever the values and their spread, and these are counted one by
    one. Borders are left out of what they border, so a value that most samples have is
    found or gone at once. Null keys are left out.
    """
    rows = samples.where("sample IS NOT NULL").select(*keys, "sample")
    kind = rows.schema["sample"].dataType
    whole = staged(rows.groupBy(*keys).agg(F.count("*").alias("n")), "sizes")
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items())))
    none = F.lit(None).cast(kind)
    state = whole.withColumn("want", wanted).select(*keys, "want.name", F.col("want.rank").alias("left"), none.alias("low"), none.alias("high"), F.col("n").alias("size"), none.alias("value"))
    columns = state.columns
    while True:
        state = staged(state, "ranks")
        ask = state.where(F.col("value").isNull() & (F.col("size") > FEW))
        if ask.isEmpty():
            break
        grid = F.percentile_approx("sample", [i / STEPS for i in range(STEPS + 1)], ACCURACY)
        at = F.floor(F.col("left") / F.col("size") * STEPS).cast("int")
        picked = _inside(rows, ask, keys).groupBy(*keys, "name").agg(grid.alias("grid")).join(ask, [*keys, "name"])
        picked = staged(picked.withColumns({"a": F.get("grid", F.greatest(at - 1, F.lit(0))), "b": F.get("grid", F.least(at + 2, F.lit(STEPS)))}).drop("grid"), "borders")
        tests = {"below_a": F.col("sample") < F.col("a"), "upto_a": F.col("sample") <= F.col("a"), "below_b": F.col("sample") < F.col("b"), "upto_b": F.col("sample") <= F.col("b")}
        counts = _inside(rows, picked, keys).groupBy(*keys, "name").agg(*(F.count_if(x).alias(n) for n, x in tests.items()))
        told = picked.join(counts, [*keys, "name"])
        left, field = F.col("left"), F.col
        under, middle, over = left < field("below_a"), (left >= field("upto_a")) & (left < field("below_b")), left >= field("upto_b")
        value = F.when((left >= field("below_a")) & (left < field("upto_a")), field("a")).when((left >= field("below_b")) & (left < field("upto_b")), field("b"))
        told = told.withColumns({"value": value, "new_low": F.when(middle, field("a")).when(over, field("b")).otherwise(field("low")), "new_high": F.when(under, field("a")).when(middle, field("b")).otherwise(field("high")), "new_left": F.when(middle, left - field("upto_a")).when(over, left - field("upto_b")).otherwise(left), "new_size": F.when(under, field("below_a")).when(middle, field("below_b") - field("upto_a")).when(over, field("size") - field("upto_b")).otherwise(field("size"))})
        told = told.select(*keys, "name", *(F.col(f"new_{c}").alias(c) for c in ("left", "low", "high", "size")), "value").select(columns)
        state = state.where(F.col("value").isNotNull() | (F.col("size") <= FEW)).union(told)
    rest = state.where("value IS NULL")
    fine = _inside(rows, rest, keys).groupBy(*keys, "name", "sample").agg(F.count("*").alias("times"), F.first("left").alias("left"))
    upto = F.sum("times").over(Window.partitionBy(*keys, "name").orderBy("sample"))
    found = fine.withColumn("upto", upto).where("upto > left").groupBy(*keys, "name").agg(F.min("sample").alias("value"))
    every = found.union(state.where("value IS NOT NULL").select(*keys, "name", "value"))
    return whole.join(every.groupBy(*keys).pivot("name", list(ranks)).agg(F.first("value")), keys)


def latency_percentiles(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest-rank p50 and p95 of samples that are not null."""
    rank = lambda p: F.ceil(F.col("n") * p / 100) - 1
    return _of_rank(samples, keys, {"p50": rank(50), "p95": rank(95)}).select(*keys, "p50", "p95", "n")


def upper_median(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The element at n div 2 of the sorted samples."""
    return _of_rank(samples, keys, {"median": F.floor(F.col("n") / 2)}).select(*keys, "median")


def overhead_ratio(samples: DataFrame) -> DataFrame:
    """Per case: the medians of the baseline and targeted modes, what is added, and their ratio (null for a baseline of zero)."""
    med = upper_median(samples, ["case_id", "mode"]).groupBy("case_id").pivot("mode", ["baseline", "targeted"]).agg(F.first("median"))
    return med.select("case_id", "baseline", "targeted", (F.col("targeted") - F.col("baseline")).alias("added"), F.round(F.try_divide("targeted", "baseline"), 6).alias("ratio"))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """before and after (name, value): the speed-up, null where one is missing or after is zero."""
    b, a = before.select("name", F.col("value").alias("before")), after.select("name", F.col("value").alias("after"))
    return b.join(a, "name", "full_outer").withColumn("speedup", F.round(F.try_divide("before", "after"), 6))


def suite_report(checks: DataFrame) -> DataFrame:
    """checks (case_id, passed): cases, checks passed and in all, and whether every one passed."""
    cases = checks.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if("passed").alias("ok"))
    return cases.agg(F.count("*").alias("cases"), F.sum("ok").alias("passed"), F.sum("n").alias("checks"), F.count_if(F.col("ok") == F.col("n")).alias("cases_passed"))


def suite_summary(checks: DataFrame, matrix: DataFrame) -> DataFrame:
    """One row: `suite_report` of checks, with the false confirmations and replays of matrix (case_id, false_confirmations, replays, replays_equal) and the status: passed if every check passed, none was falsely confirmed and each replay was equal."""
    sums = matrix.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("false_confirmations", "replays", "replays_equal")))
    whole = suite_report(checks).join(F.broadcast(sums))  # a row each
    ok = (F.col("passed") == F.col("checks")) & (F.col("false_confirmations") == 0) & (F.col("replays") == F.col("replays_equal"))
    return whole.withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "passed").otherwise("failed"))


def compare_measured(before: DataFrame, after: DataFrame) -> DataFrame:
    """`compare_runs` of before and after (name, value, fixture, runtime), with comparable: whether both have the case, of one fixture and runtime. Only then there is a speed-up."""
    b, a = (t.select("name", *(F.col(c).alias(f"{c}{n}") for c in ("value", "fixture", "runtime"))) for t, n in ((before, "_b"), (after, "_a")))
    same = F.coalesce((F.col("fixture_b") == F.col("fixture_a")) & (F.col("runtime_b") == F.col("runtime_a")), F.lit(False))
    both = b.join(a, "name", "full_outer").withColumn("comparable", same)
    return both.select("name", F.col("value_b").alias("before"), F.col("value_a").alias("after"), "comparable", F.when(F.col("comparable"), F.round(F.try_divide("value_b", "value_a"), 6)).alias("speedup"))


def same_semantics(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one report has and the other has not, as often as it has them more."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).union(b.exceptAll(a).withColumn("side", F.lit("second")))


_WORD, _NOT = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
#: Words of the runs that literals are looked up by, and distinct runs that may be sent to each executor.
RUN, RUNS = 3, 500_000


def _runs(words: Column, size: int) -> Column:
    """The hashes of the runs of `size` words."""
    count = F.size(words) - size + 1
    return F.when(count >= 1, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))).otherwise(F.array().cast("array<bigint>"))


def leak_audit(documents: DataFrame, literals: DataFrame) -> DataFrame:
    """(literal_id, documents): forbidden literals by how many texts (doc_id) hold them, in any case.

    A literal with whole words inside is looked up by a run of up to RUN of them: the runs of
    all literals are joined with those of the texts in one pass, the rarest run of each literal
    names the texts that may hold it, and these are searched for it. So the work does not grow
    with the number of literals, but with the texts and the hits of the rarest runs. Literals
    without a whole word inside (one or two words, signs) are looked for by automata of
    LITERALS of them, in as many passes. An empty literal stands in every text. Nulls are left out.
    """
    named = literals.where("literal IS NOT NULL").select("literal_id", F.lower("literal").alias("literal"))
    texts = documents.where("text IS NOT NULL").select("doc_id", F.lower("text").alias("text"))
    # a word between two other signs of the literal is a whole word of every text that holds it
    words = F.regexp_extract_all("literal", F.lit(f"(?<={_NOT}){_WORD}+(?={_NOT})"), F.lit(0))
    split = staged(named.withColumn("words", words), "literals")
    found = _by_runs(texts, split.where(F.size("words") > 0)).union(_by_automata(texts, split.where(F.size("words") == 0).drop("words")))
    return found.groupBy("literal_id").agg(F.count_distinct("doc_id").alias("documents"))


def _by_runs(texts: DataFrame, literals: DataFrame) -> DataFrame:
    sized = literals.withColumn("size", F.least(F.size("words"), F.lit(RUN)))
    own = staged(sized.select("literal_id", "literal", "size", F.explode(F.array_distinct(F.coalesce(*(F.when(F.col("size") == n, _runs(F.col("words"), n)) for n in range(1, RUN + 1))))).alias("run")), "runs")
    # texts are cut into runs of the sizes that some literal asks for
    sizes = [r[0] for r in own.select("size").distinct().collect()]
    if not sizes:
        return texts.join(literals.select("literal_id").limit(0)).select("doc_id", "literal_id")
    words = F.regexp_extract_all("text", F.lit(f"{_WORD}+"), F.lit(0))
    # a table of fewer splits than cores is dealt to all of them
    cores = texts.sparkSession.sparkContext.defaultParallelism
    dealt = texts.repartition(cores) if texts.rdd.getNumPartitions() < cores else texts
    every = dealt.select("doc_id", words.alias("words")).select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*(_runs(F.col("words"), n) for n in sizes))))).alias("run"))
    asked = own.select("run").distinct()
    hits = staged(every.join(F.broadcast(asked) if asked.count() <= RUNS else asked, "run", "left_semi"), "hits")
    often = hits.groupBy("run").agg(F.count("*").alias("texts"))
    # a run that no text has rules its literal out
    rarest = own.join(often, "run", "left").groupBy("literal_id", "literal").agg(F.min_by("run", F.coalesce("texts", F.lit(0))).alias("run"))
    pairs = rarest.join(hits, "run").select("literal_id", "literal", "doc_id").distinct()
    return pairs.join(texts, "doc_id").where(F.contains("text", F.col("literal"))).select("doc_id", "literal_id")


def _by_automata(texts: DataFrame, named: DataFrame) -> DataFrame:
    passes = max(1, -(-named.count() // LITERALS))
    hits = None
    for part in range(passes):
        # LITERALS of them, more or less, by the draw of a hash
        some = named.where(F.pmod(F.xxhash64("literal_id"), F.lit(passes)) == part).collect()
        find = _finder([tuple(r) for r in some])
        found = texts.mapInPandas(find, f"doc_id {dict(texts.dtypes)['doc_id']}, literal_id {dict(named.dtypes)['literal_id']}") if some else texts.join(named.select("literal_id").limit(0)).select("doc_id", "literal_id")
        hits = found if hits is None else hits.union(found)
    return hits


def _finder(literals: list[tuple]):  # noqa: ANN202
    ids: dict[str, list] = {}
    for literal_id, text in literals:
        ids.setdefault(text, []).append(literal_id)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for text, own in ids.items():
            if text:
                automaton.add_word(text, own)
        automaton.make_automaton()
        for batch in batches:
            out = []
            for doc, text in batch[["doc_id", "text"]].itertuples(index=False):
                seen = set(ids.get("", ()))
                if len(automaton):
                    for _, own in automaton.iter(text):
                        seen.update(own)
                out += [(doc, x) for x in seen]
            yield pd.DataFrame(out, columns=["doc_id", "literal_id"])

    return find


def job_rate_share(scans: DataFrame, targets: DataFrame) -> DataFrame:
    """Per scan (scan_id, rate, most): jobs at a time, and each one's share of the rate."""
    n = targets.groupBy("scan_id").agg(F.count("*").alias("targets"))
    jobs = F.greatest(F.lit(1), F.least("most", "rate", "targets"))
    return scans.join(n, "scan_id").select("scan_id", jobs.alias("jobs"), F.expr("rate DIV greatest(1, least(most, rate, targets))").alias("share"))


def replay_values(seeds: DataFrame) -> DataFrame:
    """The distinct values of each property, with the least seed id of each."""
    return seeds.groupBy("property", "value").agg(F.min("seed_id").alias("seed_id"))


def ambiguity_count(facts: DataFrame) -> DataFrame:
    """Facts whose resolution stayed open, by how."""
    return facts.where(F.col("resolution").isin("ambiguous_import", "dynamic_dispatch", "local_or_imported")).groupBy("resolution").agg(F.count("*").alias("n"))


def candidate_reduction(facts: DataFrame) -> DataFrame:
    """Selected sink candidates over all, zero where there are none."""
    return facts.agg(F.count_if("selected").alias("selected"), F.count("*").alias("all")).withColumn("ratio", F.round(F.coalesce(F.try_divide("selected", "all"), F.lit(0.0)), 6))
