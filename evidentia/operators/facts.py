"""The fact table: queries, pages, derived facts, scopes, as-of resolution and order windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged
from .scan import numbered, scanned


def query_facts(facts: DataFrame, prefixes: dict[str, str] | None = None, **equal: object) -> DataFrame:
    """facts that match all exact values and prefixes."""
    out = facts
    for name, value in equal.items():
        out = out.where(F.col(name) == F.lit(value))
    for name, value in (prefixes or {}).items():
        out = out.where(F.startswith(F.col(name), F.lit(value)))
    return out


def fact_page(facts: DataFrame, order: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page in a total order, with the exact total and the next offset (null at the end)."""
    total = facts.agg(F.count("*").alias("total"))
    page = facts.orderBy(*order).offset(offset).limit(limit)
    following = F.when(F.lit(offset + limit) < F.col("total"), F.lit(offset + limit))
    return page.join(F.broadcast(total)).withColumn("next_offset", following.cast("long"))


def inventory_summary(facts: DataFrame) -> DataFrame:
    """Counts of facts and of their distinct subjects by kind, by relation and in all."""
    return facts.groupingSets([[F.col("kind")], [F.col("relation")], []], "kind", "relation").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"))


def occurrence_index(matches: DataFrame, order: list[str]) -> DataFrame:
    """The place, from one, of each match among those of its rule, file and anchor."""
    return numbered(matches, ["rule_id", "file", "anchor"], order, "occurrence")


def derive_module_owners(modules: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(module, package) where exactly one package defines a module; what a caller gives (module, package: one row a module) goes before, and holds for modules that none defines too."""
    found = modules.groupBy("module").agg(F.min("package").alias("package"), F.max("package").alias("other"))
    derived = found.where("package = other").drop("other")
    if given is None:
        return derived
    return derived.join(given, "module", "left_anti").unionByName(given.select("module", "package"))


def inventory_totals(facts: DataFrame, diagnostics: DataFrame, owners: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: facts, subjects, packages that own a module, sources (path) and diagnostics (level) in all and by level."""
    levels = [F.count_if(F.col("level") == x).alias(f"{x}s") for x in ("error", "warning")]
    rows = (facts.agg(F.count("*").alias("facts"), F.count_distinct("subject").alias("subjects")), owners.agg(F.count_distinct("package").alias("packages")), sources.agg(F.count_distinct("path").alias("sources")), diagnostics.agg(F.count("*").alias("diagnostics"), *levels))
    return reduce(lambda a, b: a.join(F.broadcast(b)), rows)  # a row each


def fact_page_after(facts: DataFrame, order: list[str], after: tuple | None = None, limit: int = 100) -> DataFrame:
    """The next `limit` facts behind a key (the values of the columns of order of the last one seen; None begins), in a total order without nulls. A deep page costs what the first does: the key is a filter and not an offset."""
    rows = facts
    if after is not None:
        behind, equal = F.lit(False), F.lit(True)
        for name, value in zip(order, after, strict=True):
            behind = behind | (equal & (F.col(name) > F.lit(value)))
            equal = equal & (F.col(name) == F.lit(value))
        rows = facts.where(behind)
    return rows.orderBy(*order).limit(limit)


def dotted_prefixes(name: Column) -> Column:
    """All prefixes of a dotted name that end at a border, the whole name included."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def longest_prefix(matches: DataFrame, key: list[str], prefix: str = "module") -> DataFrame:
    """One of the matches of each key: that with the prefix of most bytes, the least of equal ones by all columns."""
    rest = [c for c in matches.columns if c not in key]
    best = F.min(F.struct((-F.octet_length(prefix)).alias("_n"), *rest)).alias("best")
    return matches.where(F.col(prefix).isNotNull()).groupBy(*key).agg(best).select(*key, *(f"best.{c}" for c in rest))


def package_uses(calls: DataFrame, owners: DataFrame) -> DataFrame:
    """calls (call_id, target) with the package of the longest owned prefix of their target; others are left out. Targets' prefixes join the owners, so no pair is compared."""
    prefixes = calls.select("call_id", "target", F.explode(dotted_prefixes(F.col("target"))).alias("module"))
    return longest_prefix(prefixes.join(owners.select("module", "package"), "module"), ["call_id", "target"]).select("call_id", "target", "module", "package")


def _cover(spans: DataFrame) -> DataFrame:
    """spans (file, first, last) with each dyadic block (level, block) that they are made of: two for each power of two up to their length at most, and one of them around each line."""
    size = F.greatest(F.col("last") - F.col("first") + 1, F.lit(1)).cast("double")
    shift = lambda way, x, k: F.call_function(f"shift{way}", x, k)
    level = F.col("level")
    leveled = spans.where("first <= last").withColumn("level", F.explode(F.sequence(F.lit(0), F.ceil(F.log2(size)).cast("int") + 1)))
    left = shift("right", F.col("first") + shift("left", F.lit(1).cast("long"), level) - 1, level)
    right = shift("right", F.col("last") + 1, level)
    odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
    some = leveled.withColumn("_l", left).withColumn("_r", right).where("_l < _r")
    blocks = F.array(F.when(odd(F.col("_l")), F.col("_l")), F.when(odd(F.col("_r")), F.col("_r") - 1))
    return some.withColumn("block", F.explode(blocks)).where("block IS NOT NULL").drop("_l", "_r")


def _held(points: DataFrame, spans: DataFrame, *sums: Column) -> DataFrame:
    """sums of the spans of each block, for each distinct line (file, at) of points in it: a row for each block with spans.

    Sums are taken for a block before any join, so a join key has one row on that side, and the
    rows are those of lines times the powers of two up to the longest span.
    """
    cover = _cover(spans).groupBy("file", "level", "block").agg(*sums)
    top = cover.agg(F.max("level")).first()[0] or 0
    lines = points.select("file", "at").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    return lines.withColumn("block", F.call_function("shiftright", F.col("at"), F.col("level"))).join(cover, ["file", "level", "block"])


def enclosing_scope(points: DataFrame, spans: DataFrame) -> DataFrame:
    """The innermost span (scope_id, first, last) around each point (file, point_id, at): the last to begin, then the first to end; null where none is."""
    best = F.max(F.struct("first", (-F.col("last")).alias("end"), "scope_id")).alias("best")
    inner = _held(points, spans, best).groupBy("file", "at").agg(F.max("best").alias("best"))
    return points.join(inner, ["file", "at"], "left").select("point_id", F.col("best.scope_id").alias("scope_id"))


def control_contexts(points: DataFrame, spans: DataFrame) -> DataFrame:
    """How many spans hold each point, and the first and last to begin."""
    own = F.struct("first", "last", "scope_id")
    held = _held(points, spans, F.count("*").alias("n"), F.min(own).alias("outer"), F.max(own).alias("inner"))
    lines = held.groupBy("file", "at").agg(F.sum("n").alias("n"), F.min("outer").alias("outer"), F.max("inner").alias("inner"))
    return points.join(lines, ["file", "at"]).select("point_id", "n", F.col("outer.scope_id").alias("outer"), F.col("inner.scope_id").alias("inner"))


def as_of(points: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, point_id, at) with the value of the latest change (keys, since, value) at or before them.

    One scan over both tables carries the last change on, so no pair is formed and a key with
    most rows is no one task. Of changes at one time the largest value counts; a point sees the
    changes of its own time.
    """
    both = points.select(*keys, "at", F.lit(1).alias("kind"), "point_id", F.lit(None).cast(changes.schema["value"].dataType).alias("value")).unionByName(
        changes.select(*keys, F.col("since").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"), "value")
    )
    carried = scanned(both, keys, ["at", "kind", "value"], found=("last", F.col("value")))
    return carried.where("kind = 1").select(*keys, "point_id", F.col("found").alias("value"))


def resolve_imports(calls: DataFrame, definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """calls (call_id, file, name) are local if their file defines the name, else of the one import that gives it, else ambiguous or unknown."""
    local = definitions.select("file", "name").distinct().withColumn("local", F.lit(True))
    given = imports.groupBy("file", "name").agg(F.count_distinct("module").alias("n"), F.min("module").alias("module"))
    resolution = F.when(F.col("local"), "local").when(F.col("n") == 1, "imported").when(F.col("n") > 1, "ambiguous_import").otherwise("local_or_imported")
    joined = calls.join(local, ["file", "name"], "left").join(given, ["file", "name"], "left").withColumn("resolution", resolution)
    return joined.select("call_id", "resolution", F.when(F.col("resolution") == "imported", F.col("module")).alias("module"))


def reaching_definitions(uses: DataFrame, bindings: DataFrame, k: int = 8, parameters: DataFrame | None = None) -> DataFrame:
    """The nearest k bindings (file, variable, at, binding_id) at or before each use (file, variable, at, use_id), itself left out; truncated where there were more.

    Bindings are numbered in their order, a use learns how many stand at or before it from one
    scan over both tables, and takes those numbers by an equi-join: at most k + 1 rows a use,
    however many bindings a variable has. binding_id is unique. With parameters (file, variable,
    parameter_id), a use that no binding reaches takes those of its variable, and a column
    source tells bindings and parameters apart.
    """
    keys = ["file", "variable"]
    placed = numbered(bindings.select(*keys, "at", "binding_id"), keys, ["at", F.desc("binding_id")]).select(*keys, "place", "binding_id")
    both = uses.select(*keys, "at", F.lit(1).alias("kind"), "use_id").unionByName(bindings.select(*keys, "at", F.lit(0).alias("kind"), F.lit(None).cast(uses.schema["use_id"].dataType).alias("use_id")))
    counted = scanned(both, keys, ["at", "kind"], upto=("sum", (F.col("kind") == 0).cast("long"))).where("kind = 1")
    own = bindings.select(*keys, F.col("binding_id").alias("use_id"), F.col("at").alias("bound"))
    asked = counted.join(own, [*keys, "use_id"], "left").withColumn("n", F.col("upto") - F.coalesce((F.col("bound") <= F.col("at")).cast("int"), F.lit(0)))
    near = asked.where("n > 0").withColumn("place", F.explode(F.sequence(F.greatest(F.col("upto") - k, F.lit(1)), F.col("upto")))).join(placed, [*keys, "place"]).where("binding_id <> use_id")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("use_id").orderBy(F.desc("place"))))
    found = ranked.where(F.col("rank") <= k).select("use_id", "binding_id", "rank", (F.col("n") > k).alias("truncated"), (F.col("n") > 1).alias("multiple"))
    if parameters is None:
        return found
    given = numbered(parameters.select(*keys, "parameter_id"), keys, ["parameter_id"], "rank")
    rest = asked.where("n = 0").join(given, keys).select("use_id", F.col("parameter_id").alias("binding_id"), F.col("rank").cast("int"), F.lit(False).alias("truncated"), F.lit(False).alias("multiple"))
    return found.withColumn("source", F.lit("binding")).union(rest.withColumn("source", F.lit("parameter")))


#: Members of a set that it is small with: its subsets are counted.
SMALL_SET = 5


def meetings(calls: DataFrame, column: str) -> DataFrame:
    """How many other calls (call_id, subject, `column`: an array) of a subject share a member with each; none for those without members.

    Calls with equal sets are one row with a count. For sets of SMALL_SET members at most, the
    small sets that meet them are counted by inclusion and exclusion: one row for each subset of
    a set (31 at most), added up, and taken with changing sign by the sets that hold it. So
    small sets form no pairs. A larger set is paired with the sets that it meets.
    """
    sets = calls.select("subject", F.array_sort(F.array_distinct(column)).alias("s")).groupBy("subject", "s").agg(F.count("*").alias("size")).where(F.size("s") > 0)
    small, large = sets.where(F.size("s") <= SMALL_SET), sets.where(F.size("s") > SMALL_SET)
    picks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("s")) - 1)
    part = lambda mask: F.filter("s", lambda _, i: F.call_function("getbit", mask, i) == 1)
    parts = small.select("subject", "s", "size", F.explode(F.transform(picks, part)).alias("part"))
    holding = parts.groupBy("subject", "part").agg(F.sum("size").alias("held"))
    sign = F.when(F.size("part") % 2 == 1, F.col("held")).otherwise(-F.col("held"))
    met = parts.join(holding, ["subject", "part"]).groupBy("subject", "s").agg(F.sum(sign).alias("n"))
    each = sets.select("subject", "s", "size", F.explode("s").alias("m"))
    mine = large.select("subject", F.col("s").alias("big"), F.col("size").alias("big_size"), F.explode("s").alias("m"))
    pairs = each.join(mine, ["subject", "m"]).select("subject", "s", "size", "big", "big_size").distinct()
    of_large = pairs.groupBy("subject", F.col("big").alias("s")).agg(F.sum("size").alias("n"))
    to_small = pairs.where(F.size("s") <= SMALL_SET).groupBy("subject", "s").agg(F.sum("big_size").alias("n"))
    total = met.unionByName(of_large).unionByName(to_small).groupBy("subject", "s").agg((F.sum("n") - 1).alias("n"))
    return calls.withColumn("s", F.array_sort(F.array_distinct(column))).join(total, ["subject", "s"]).select("call_id", "n")


def shared_variables(calls: DataFrame) -> DataFrame:
    """How many other calls (call_id, subject, variables) of a subject share a variable with each; none for those without any."""
    return meetings(calls, "variables")


#: Lines of a leaf of a digest tree, about.
LEAF = 1024


def digest_tree(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, digest, n) of rows (keys, line): a digest of each group's lines, whatever their order; equal lines are one with its count.

    A group's lines are dealt by their own digests to as many leaves as keep LEAF of them each,
    about, and sixteen nodes make one of the next level. So no row gathers more, at any size:
    a leaf's sorted lines, or sixteen lines `node:digest`, are what is digested.
    """
    lines = rows.groupBy(*keys, "line").agg(F.count("*").alias("times")).select(*keys, F.concat("line", F.lit("*"), F.col("times").cast("string")).alias("line"), "times")
    groups = lines.groupBy(*keys).agg(F.count("*").alias("_lines"), F.sum("times").alias("n"))
    depth = sum((F.col("_lines") > LEAF * 16**d).cast("int") for d in range(12))
    groups = staged(groups.withColumn("_depth", depth).drop("_lines"), "groups")
    deepest = groups.agg(F.max("_depth")).first()[0] or 0
    on = F.lit(True)
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"_g_{key}"))
    named = groups.select(*(F.col(k).alias(f"_g_{k}") for k in keys), "_depth")
    dealt = lines.join(named, on) if keys else lines.withColumn("_depth", F.lit(deepest))
    level = dealt.select(*keys, F.expr("left(sha2(line, 256), _depth)").alias("node"), "line")
    text = F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256)
    for d in range(deepest, 0, -1):
        whole = level.where(F.length("node") == d).groupBy(*keys, "node").agg(text.alias("digest"))
        above = whole.select(*keys, F.expr(f"left(node, {d - 1})").alias("node"), F.concat("node", F.lit(":"), "digest").alias("line"))
        level = level.where(F.length("node") < d).unionByName(above)
    roots = level.groupBy(*keys).agg(text.alias("digest"))
    same = F.lit(True)
    for key in keys:
        same = same & roots[key].eqNullSafe(F.col(f"_g_{key}"))
    sizes = groups.select(*(F.col(k).alias(f"_g_{k}") for k in keys), "n")
    return roots.join(sizes, same).select(*keys, "digest", "n") if keys else roots.withColumn("n", F.lit(groups.agg(F.sum("n")).first()[0] or 0).cast("long"))


def callback_implementations(facts: DataFrame) -> DataFrame:
    """implements ⋈ callback ⋈ definition: facts (kind, subject, object, signature)."""
    directive = facts.where("kind = 'implements'").select(F.col("subject").alias("module"), F.col("object").alias("interface"))
    callback = facts.where("kind = 'callback'").select(F.col("subject").alias("interface"), "signature")
    definition = facts.where("kind = 'definition'").select(F.col("object").alias("target"), F.col("subject").alias("definition")).distinct()
    wanted = directive.distinct().join(callback.distinct(), "interface").withColumn("target", F.concat("module", F.lit("."), "signature"))
    return wanted.join(definition, "target").select("interface", "module", "signature", "definition")


def component_checksum(sources: DataFrame) -> DataFrame:
    """(component, checksum, files): the digest tree of a component's (path, digest of content)."""
    lines = sources.select("component", F.concat("path", F.lit("="), F.sha2("content", 256)).alias("line"))
    return digest_tree(lines, ["component"]).select("component", F.col("digest").alias("checksum"), F.col("n").alias("files"))


def parse_suppressions(comments: DataFrame, marker: str = "evidence-ignore") -> DataFrame:
    """comments (comment_id, line, text) that mention the marker: the rule, the line after and the reason, or malformed."""
    form = rf"{marker}:\s*([a-z0-9_.-]+)\s+--\s+(\S.*)$"
    hit = comments.where(F.contains("text", F.lit(marker)))
    ok = F.col("text").rlike(form)
    return hit.select("comment_id", ok.alias("valid"), F.when(ok, F.regexp_extract("text", form, 1)).alias("rule_id"), F.when(ok, F.col("line") + 1).alias("target_line"), F.when(ok, F.trim(F.regexp_extract("text", form, 2))).alias("reason"))
