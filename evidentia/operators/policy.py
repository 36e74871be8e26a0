"""Contracts, classifications, resolutions and reports over plans, facts, candidates and submissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.policy import canonical_ip
from .facts import digest_tree, meetings
from .scan import paired

from ..functions.policy import KEYWORD, render_template, wire_value
from ..functions.scalars import normalize_url, stable_id

#: Behaviours of calls: (behaviour, basis, modules, functions or None for all of a module). Fixed values.
CALLS = (
    ("process_message_send", "known_api", ("Kernel", "Process", "erlang"), ("send",)),
    ("process_message_send", "known_api", ("GenServer", "gen_server"), ("cast",)),
    ("otp_request", "known_api", ("GenServer", "gen_server"), ("call",)),
    ("otp_request", "known_api", ("Supervisor", "DynamicSupervisor"), ("start_child",)),
    ("shared_state_access", "module_family", ("ets", "dets", "mnesia", "persistent_term"), None),
    ("process_state_access", "known_api", ("Process", "erlang"), ("get", "put", "delete", "get_keys")),
    ("filesystem_access", "module_family", ("File", "Path", "file", "filelib", "zip", "erl_tar"), None),
    ("network_access", "module_family", ("gen_tcp", "gen_udp", "ssl", "httpc", "Req", "Finch", "Mint.HTTP", "HTTPoison", "Tesla", "Bandit", "Plug.Conn"), None),
    ("external_process", "known_api", ("System", "os", "Port"), ("cmd", "shell", "open", "spawn", "spawn_executable")),
    ("native_code_boundary", "known_api", ("erlang", "Rustler"), ("load_nif",)),
    ("native_code_boundary", "known_api", ("Code",), ("prepend_path",)),
    ("native_code_boundary", "known_api", ("code",), ("load_binary",)),
    ("dynamic_code", "known_api", ("Code", "EEx", "erl_eval"), ("eval_file", "eval_quoted", "eval_string", "expr", "exprs")),
    ("configuration_read", "known_api", ("Application", "application"), ("get_env", "fetch_env", "fetch_env!", "get_all_env")),
    ("environment_read", "known_api", ("System", "os"), ("get_env", "getenv")),
    ("deserialization", "known_api", ("erlang",), ("binary_to_term",)),
    ("deserialization", "known_api", ("Jason",), ("decode", "decode!")),
    ("deserialization", "known_api", ("jiffy", "jsx"), ("decode",)),
    ("deserialization", "known_api", ("yaml_elixir", "YamlElixir"), ("read_from_string",)),
    ("cryptography", "module_family", ("crypto", "public_key", "Plug.Crypto", "Pbkdf2", "Argon2", "Bcrypt"), None),
    ("randomness", "known_api", ("rand", "crypto"), ("uniform", "bytes", "strong_rand_bytes", "rand_seed")),
    ("resource_amplification", "known_api", ("Enum",), ("to_list", "map", "flat_map")),
    ("resource_amplification", "known_api", ("String", "List"), ("duplicate",)),
    ("resource_amplification", "known_api", ("binary",), ("copy",)),
    ("resource_amplification", "known_api", ("zlib",), ("uncompress",)),
    ("resource_amplification", "known_api", ("zip", "erl_tar"), ("extract",)),
)
#: Behaviours of unqualified calls. Fixed values.
UNQUALIFIED = (("process_message_send", ("send",)), ("external_process", ("open_port",)), ("dynamic_dispatch", ("apply", "spawn", "spawn_link", "spawn_monitor")))
#: Behaviours of definitions by their name. Fixed values.
NAMES = (("authorization_boundary", "authoriz|permit|allowed|can_"), ("authentication_boundary", "authenticat|login|sign_in|verify_credential"))
#: Predicates whose forced answer lets something through. Fixed values.
ALLOW = ("authenticated?", "authorized?", "allowed?", "permitted?", "has_permission?", "can_access?", "trusted?", "verified?", "valid_signature?", "csrf_valid?")
DENY = ("blocked?", "denied?", "forbidden?", "revoked?", "expired?", "rate_limited?", "throttled?")
#: Comparisons in constant time: (module, function). Fixed values.
CONSTANT_TIME = (("Plug.Crypto", "secure_compare"), ("crypto", "hash_equals"))


def package_usage(facts: DataFrame, package: str) -> DataFrame:
    """The references to one package."""
    return facts.where((F.col("kind") == "package_use") & (F.col("object") == package))


def classify_behaviors(facts: DataFrame) -> DataFrame:
    """(fact_id, behavior, basis) of facts (fact_id, kind, module, function, object, resolution, source): none, one or several for each fact."""
    call, bare = F.col("kind") == "call", F.col("kind") == "unqualified_call"
    tag = lambda test, behavior, basis: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(behavior).alias("behavior"), F.lit(basis).alias("basis")))
    name = F.regexp_extract("object", r"([^./]*)(?:/[^.]*)?$", 1)
    tags = [tag(call & (F.col("resolution") == "dynamic_dispatch"), "dynamic_dispatch", "dynamic_receiver")]
    tags += [tag(call & F.col("module").isin(*m) & (F.lit(True) if f is None else F.col("function").isin(*f)), b, basis) for b, basis, m, f in CALLS]
    tags += [tag(bare & F.col("function").isin(*f), b, "unqualified_name") for b, f in UNQUALIFIED]
    tags += [tag((F.col("kind") == "definition") & name.rlike(p), b, "function_name") for b, p in NAMES]
    tags.append(tag((F.col("kind") == "dependency") & F.col("source").isin("git", "github", "path"), "non_registry_dependency", "dependency_source"))
    return facts.select("fact_id", F.explode(F.array_distinct(F.array_compact(F.array(*tags)))).alias("b")).select("fact_id", "b.*")


#: Calls that clean what they are given, and response headers that protect a browser.
SANITIZERS = ("sanitize", "sanitize_html", "html_escape", "escape_html", "strip_tags", "redact", "redact_secret", "mask_secret", "filter_input", "clean_html")
HEADERS = ("content-security-policy", "cross-origin-embedder-policy", "cross-origin-opener-policy", "cross-origin-resource-policy", "permissions-policy", "referrer-policy", "strict-transport-security", "x-content-type-options", "x-frame-options")


def mutation_candidates(calls: DataFrame) -> DataFrame:
    """(call_id, mutator, change) of calls (call_id, module, function, arity and, if given, header: a literal second argument, options: a map of literal options).

    Security decisions to force, constant-time comparisons to weaken, sanitizers of another
    module to go around, writes of protective headers to remove (names in any case), and TLS
    options to turn off. A call has a row for each that fits.
    """
    for name, kind in (("header", "string"), ("options", "map<string,string>")):
        if name not in calls.columns:
            calls = calls.withColumn(name, F.lit(None).cast(kind))
    f, header, option = F.col("function"), F.lower("header"), lambda k: F.try_element_at("options", F.lit(k))
    secure = reduce(lambda a, b: a | b, ((F.col("module") == m) & (f == n) for m, n in CONSTANT_TIME)) & (F.col("arity") == 2)
    write = (F.col("module") == "Plug.Conn") & (f == "put_resp_header") & (F.col("arity") == 3) & header.isin(*HEADERS)
    row = lambda name, change: F.struct(F.lit(name).alias("mutator"), change.alias("change"))
    options = F.array_compact(
        F.array(
            F.when(f.isin(*ALLOW), row("SecurityDecision", F.concat(F.lit("force "), f, F.lit(" to allow")))),
            F.when(f.isin(*DENY), row("SecurityDecision", F.concat(F.lit("force "), f, F.lit(" to return false")))),
            F.when(F.coalesce(secure, F.lit(False)), row("SecureCompare", F.concat(F.lit("downgrade "), "module", F.lit("."), f, F.lit("/2")))),
            F.when(F.col("module").isNotNull() & f.isin(*SANITIZERS) & (F.col("arity") > 0), row("SanitizerBypass", F.concat(F.lit("bypass "), f))),
            F.when(F.coalesce(write, F.lit(False)), row("SecurityHeader", F.concat(F.lit("remove "), header))),
            F.when(option("verify") == "verify_peer", row("TransportSecurity", F.lit("verify_peer to verify_none"))),
            F.when(option("check_hostname") == "true", row("TransportSecurity", F.lit("disable hostname verification"))),
        )
    )
    return calls.select("call_id", F.explode(options).alias("m")).select("call_id", "m.*")


def plan_contract(inputs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(job_id, reasons) of plans: a keyword with several input sources, a bad keyword, a body template without its keyword, a seed value with a line break, a target seed of another class.

    inputs (job_id, keyword, source, body), seeds (job_id, value, class, target). Each rule is
    one aggregate, so a plan is one row in a shuffle however many inputs it has.
    """
    by_keyword = inputs.groupBy("job_id", "keyword").agg(
        (F.count_distinct("source") > 1).alias("sources"),
        (~F.coalesce(F.col("keyword").rlike(KEYWORD), F.lit(False))).alias("name"),
        F.max(F.coalesce(~F.contains("body", "keyword"), F.lit(False))).alias("body"),
    )
    plans = by_keyword.groupBy("job_id").agg(*(F.max(c).alias(c) for c in ("sources", "name", "body")))
    bad = seeds.groupBy("job_id").agg(F.max(F.coalesce(F.col("value").rlike(r"[\r\n]"), F.lit(False))).alias("line"), F.max(F.coalesce("target", F.lit(False)) & (F.coalesce("class", F.lit("")) != "target")).alias("class"))
    rules = (("sources", "several sources of a keyword"), ("name", "invalid keyword"), ("body", "body without its keyword"), ("line", "line break in a seed"), ("class", "target seed of another class"))
    return plans.join(bad, "job_id", "full_outer").select("job_id", F.concat_ws(",", *(F.when(F.coalesce(c, F.lit(False)), text) for c, text in rules)).alias("reasons"))


def candidate_contract(candidates: DataFrame, most: int = 32) -> DataFrame:
    """candidates (id, localization, sink_sites) with reason: unique ones have one sink site, ambiguous ones several, all from one to `most`; null where the rule holds."""
    n = F.coalesce(F.size("sink_sites"), F.lit(0))
    reason = F.when((n < 1) | (n > most), "sink sites out of bounds").when(F.col("localization").startswith("unique") & (n != 1), "unique with several sites").when((F.col("localization") == "ambiguous") & (n < 2), "ambiguous with one site")
    return candidates.withColumn("reason", reason)


def localized_sink_span(candidates: DataFrame) -> DataFrame:
    """candidates with sink_span: the site of a unique or instrumented localization, else null."""
    one = F.col("localization").startswith("unique") | (F.col("localization") == "instrumented")
    return candidates.withColumn("sink_span", F.when(one, F.get("sink_sites", F.lit(0))))


def field_policy(accesses: DataFrame, paths: DataFrame, fields: DataFrame) -> DataFrame:
    """(case_id, leaks, result) of a matrix of a case's paths (case_id, path) and protected fields (case_id, field), with accesses (case_id, path, field, privileged, restricted): visible, hidden or missing.

    A matrix is complete if the privileged actor sees every cell and the restricted actor's
    answer is known; any cell that the restricted actor sees is a leak.
    """
    seen = accesses.groupBy("case_id", "path", "field").agg(F.max("privileged").alias("privileged"), F.max("restricted").alias("restricted"))
    cells = paths.distinct().join(fields.distinct(), "case_id").join(seen, ["case_id", "path", "field"], "left")
    complete = (F.coalesce("privileged", F.lit("missing")) == "visible") & (F.coalesce("restricted", F.lit("missing")) != "missing")
    out = cells.groupBy("case_id").agg(F.min(complete).alias("complete"), F.count_if(F.col("restricted") == "visible").alias("leaks"))
    return out.select("case_id", "leaks", F.when(~F.col("complete"), "skip").when(F.col("leaks") > 0, "violation").otherwise("pass").alias("result"))


def align_enrichment(discoveries: DataFrame, hosts: DataFrame, errors: DataFrame) -> DataFrame:
    """discoveries (ip, batch) with status and reason of the enriched host (ip, status): not reported ones are down, those of a batch (batch, error) that failed are errors."""
    # addresses are compared in their canonical form; what is none stands for itself
    name = lambda c: F.coalesce(canonical_ip(c)["value"], c)
    discoveries = discoveries.withColumn("_ip", name(F.col("ip")))
    found = hosts.groupBy(name(F.col("ip")).alias("_host")).agg(F.max("status").alias("found"))
    failed = errors.groupBy("batch").agg(F.min("error").alias("error"))
    joined = discoveries.join(failed, "batch", "left").join(found, F.col("_ip").eqNullSafe(F.col("_host")), "left")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("found").isNull(), "not_reported")
    return joined.select("ip", "batch", F.when(F.col("error").isNotNull(), "error").otherwise(F.coalesce("found", F.lit("down"))).alias("status"), reason.alias("reason"))


def shared_control(calls: DataFrame) -> DataFrame:
    """How many other calls (call_id, subject, contexts) of a subject share a control region with each; none for those without any."""
    return meetings(calls, "contexts")


def task_failures(pairs: DataFrame, exits: DataFrame, reason: str) -> DataFrame:
    """Joined handoffs (reference, child, received_at) whose child ended for the reason (child, reason, at) after it had received: (reference, child, failed_at). It correlates a failure, never a flow."""
    ended = exits.where(F.col("reason") == reason).select("child", "at")
    late = pairs.join(ended, "child").where("at >= received_at")
    return late.groupBy("reference", "child").agg(F.min("at").alias("failed_at"))


def job_origin(findings: DataFrame, jobs: DataFrame) -> DataFrame:
    """(finding_id, job_id) for findings (finding_id, url) and the plan rows (job_id, template, keyword, value) that could have rendered their address: the value raw, percent-encoded or form-encoded. An equi-join on normalised addresses."""
    r = jobs.withColumn("t", F.replace("template", "keyword", F.lit("\u0000"))).select("job_id", render_template(F.col("t"), {"\u0000": F.col("value")}).alias("r"))
    urls = r.select("job_id", F.explode(F.array("r.raw", "r.percent", "r.form")).alias("u")).select("job_id", F.coalesce(normalize_url(F.col("u")), F.col("u")).alias("u")).distinct()
    found = findings.select("finding_id", F.coalesce(normalize_url(F.col("url")), F.col("url")).alias("u")).distinct()
    # a finding of one address meets a job once; only one of several can meet it again
    found = found.withColumn("n", F.count("*").over(Window.partitionBy("finding_id")))
    once = paired(found.where("n = 1").select("finding_id", "u"), urls, "u").select("finding_id", "job_id")
    again = paired(found.where("n > 1").select("finding_id", "u"), urls, "u").select("finding_id", "job_id").distinct()
    return once.union(again)


def resolve_candidates(hypotheses: DataFrame, candidates: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """hypotheses (hypothesis_id, candidate_id) with state: resolved, or what is missing: candidate, source or sink."""
    joined = hypotheses.join(candidates.select("candidate_id", "source", "sink"), "candidate_id", "left")
    joined = joined.join(sources.select("source", F.lit(True).alias("has_source")).distinct(), "source", "left").join(sinks.select("sink", F.lit(True).alias("has_sink")).distinct(), "sink", "left")
    state = F.when(F.col("source").isNull(), "candidate_missing").when(F.col("has_source").isNull(), "source_mismatch").when(F.col("has_sink").isNull(), "sink_mismatch").otherwise("resolved")
    return joined.select("hypothesis_id", "candidate_id", state.alias("state"))


def build_hypotheses(candidates: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, candidate_id, seed_id, claim): each candidate (candidate_id, source, sink) with each seed (seed_id, source, value) of its source that is not empty."""
    able = seeds.where(F.coalesce(F.octet_length("value"), F.lit(0)) > 0)
    both = paired(candidates.select("candidate_id", "source", "sink"), able.select("seed_id", "source"), "source")
    claim = F.concat(F.lit("value from "), "source", F.lit(" reaches "), "sink")
    return both.select(stable_id("hypothesis", F.col("candidate_id"), F.col("seed_id")).alias("id"), "candidate_id", "seed_id", claim.alias("claim"))


def expected_facts(expectations: DataFrame, facts: DataFrame) -> DataFrame:
    """expectations (expectation_id, subject, kind, preview, variables) with state: matched by exactly one fact (subject, kind, text, variables), missing, ambiguous, or what differs: preview, variables."""
    n = Window.partitionBy("expectation_id")
    f = facts.select("subject", "kind", F.col("text").alias("f_text"), F.array_sort("variables").alias("f_variables"))
    joined = expectations.join(f, ["subject", "kind"], "left").withColumn("n", F.count("f_text").over(n))
    first = joined.groupBy("expectation_id").agg(F.max("n").alias("n"), F.min(F.coalesce(F.contains("f_text", "preview"), F.lit(False))).alias("preview"), F.min(F.coalesce(F.array_sort("variables") == F.col("f_variables"), F.lit(False))).alias("variables"))
    state = F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").when(~F.col("preview"), "preview_differs").when(~F.col("variables"), "variables_differ").otherwise("matched")
    return first.select("expectation_id", state.alias("state"))


def score_submissions(submissions: DataFrame, keys: DataFrame, outcomes: DataFrame) -> DataFrame:
    """submissions (submission_id, case_id, class, locus) against keys (case_id, classes, fragments) and outcomes (submission_id, variant, expected, verdict, replay_equal): each rule, and whether all hold. A case without a key or a submission without outcomes fails."""
    ran = outcomes.groupBy("submission_id").agg(F.min(F.coalesce(F.col("verdict") == F.col("expected"), F.lit(False))).alias("verdicts_ok"), F.min(F.coalesce("replay_equal", F.lit(False))).alias("replay_ok"))
    joined = submissions.join(keys, "case_id", "left").join(ran, "submission_id", "left")
    cls = F.coalesce(F.array_contains("classes", F.col("class")), F.lit(False))
    locus = F.coalesce(F.forall("fragments", lambda x: F.contains("locus", x)), F.lit(False))
    rules = joined.select("submission_id", cls.alias("class_ok"), locus.alias("locus_ok"), F.coalesce("verdicts_ok", F.lit(False)).alias("verdicts_ok"), F.coalesce("replay_ok", F.lit(False)).alias("replay_ok"))
    return rules.withColumn("accepted", F.col("class_ok") & F.col("locus_ok") & F.col("verdicts_ok") & F.col("replay_ok"))


def inventory_id(facts: DataFrame, owners: DataFrame) -> DataFrame:
    """One row (inventory_id, facts): the digest tree of all fact ids (id) and owners (module, package), whatever their order. Null ids and owners without a name are left out."""
    line = facts.select(F.concat(F.lit("f:"), "id").alias("line")).union(owners.select(F.concat(F.lit("o:"), "module", F.lit("="), "package"))).where("line IS NOT NULL")
    return digest_tree(line, []).select(F.col("digest").alias("inventory_id")).join(facts.agg(F.count("id").alias("facts")))


def scan_metrics(sources: DataFrame, facts: DataFrame, matches: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row of counts of a scan, and its status: incomplete if any diagnostic is an error. sources (bytes), matches (rule_id, suppressed), diagnostics (level)."""
    s = sources.agg(F.count("*").alias("sources"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    m = matches.agg(F.count_distinct("rule_id").alias("rules"), F.count("*").alias("observations"), F.count_if("suppressed").alias("suppressed"))
    d = diagnostics.agg(F.count("*").alias("diagnostics"), F.coalesce(F.max(F.col("level") == "error"), F.lit(False)).alias("failed"))
    one = s.join(F.broadcast(facts.agg(F.count("*").alias("facts")))).join(F.broadcast(m)).join(F.broadcast(d))
    return one.withColumn("status", F.when(F.col("failed"), "incomplete").otherwise("complete")).drop("failed")


def violation_findings(results: DataFrame) -> DataFrame:
    """(id, seed_id, property, oracle, input) of results (property, oracle, result, input, no_crash): a finding and a seed for each violation; a crash counts only where no crash is declared."""
    bad = results.where((F.col("result") == "violation") | ((F.col("result") == "crash") & F.coalesce("no_crash", F.lit(False))))
    oracle = F.when(F.col("result") == "crash", "no_crash").otherwise(F.col("oracle"))
    return bad.select(stable_id("property", F.col("property"), oracle, F.col("input")).alias("id"), stable_id("counterexample", F.col("property"), F.col("input")).alias("seed_id"), "property", oracle.alias("oracle"), "input").distinct()


def boundary_scenarios(scenarios: DataFrame) -> DataFrame:
    """(matrix, scenario, events, joined, false_joins, candidates, status) of scenarios (the same, and supported): a supported one holds if all its events join and none falsely, and a known gap stays open; what does neither is failed. candidates is what equal values alone would offer."""
    holds = (F.col("joined") == F.col("events")) & (F.col("false_joins") == 0)
    status = F.when(F.col("supported") & holds, "holds").when(~F.col("supported") & (F.col("joined") < F.col("events")), "gap").otherwise("failed")
    return scenarios.select("matrix", "scenario", "events", "joined", "false_joins", "candidates", status.alias("status"))


def boundary_matrix(scenarios: DataFrame) -> DataFrame:
    """(matrix, events, joined, false_joins, status) of scenarios (matrix, events, joined, false_joins, supported): partial if all supported ones hold and the known gaps stay open, else failed. Supported ones hold if all their events join and none falsely."""
    holds = (F.col("joined") == F.col("events")) & (F.col("false_joins") == 0)
    gap_open = F.col("joined") < F.col("events")
    ok = F.when(F.col("supported"), holds).otherwise(gap_open)
    out = scenarios.groupBy("matrix").agg(*(F.sum(c).alias(c) for c in ("events", "joined", "false_joins")), F.min(F.coalesce(ok, F.lit(False))).alias("ok"), F.min("supported").alias("whole"))
    return out.select("matrix", "events", "joined", "false_joins", F.when(~F.col("ok"), "failed").when(F.col("whole"), "complete").otherwise("partial").alias("status"))


def case_provenance_contract(cases: DataFrame) -> DataFrame:
    """(case_id, reasons) of cases (case_id, vulnerable_revision, fixed_revision, advisory, project, path, license, vulnerable_hash, fixed_hash)."""
    rev = lambda c: F.coalesce(F.col(c).rlike("^[0-9a-f]{40}$"), F.lit(False))
    rules = [(~(rev("vulnerable_revision") & rev("fixed_revision")), "revision"), (F.col("vulnerable_revision").eqNullSafe(F.col("fixed_revision")), "equal revisions"), (F.col("vulnerable_hash").eqNullSafe(F.col("fixed_hash")), "equal sources")]
    rules += [(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", f"no {c}") for c in ("advisory", "project", "path", "license")]
    return cases.select("case_id", F.concat_ws(",", *(F.when(bad, text) for bad, text in rules)).alias("reasons"))


def report_contract(reports: DataFrame, checks: DataFrame) -> DataFrame:
    """(report_id, reasons) of reports (report_id, cases, passed) and checks (report_id, case_id, name, passed): cases of one id, check names that repeat, checks that failed, and summaries that are not what is counted."""
    named = checks.groupBy("report_id", "case_id", "name").agg(F.count("*").alias("n"), F.min("passed").alias("ok"))
    by_case = named.groupBy("report_id", "case_id").agg(F.max("n").alias("most"), F.min("ok").alias("ok"))
    counted = by_case.groupBy("report_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.max("most").alias("most"))
    joined = reports.join(counted, "report_id", "left")
    rules = ((F.coalesce("n", F.lit(0)) != F.col("cases"), "cases differ"), (F.coalesce("ok", F.lit(0)) != F.col("passed"), "passed differs"), (F.coalesce(F.col("most") > 1, F.lit(False)), "repeated check"), (F.coalesce(F.col("ok") < F.col("n"), F.lit(True)), "failed case"))
    return joined.select("report_id", F.concat_ws(",", *(F.when(bad, text) for bad, text in rules)).alias("reasons"))


def context_facts(directives: DataFrame) -> DataFrame:
    """(file, modules, imports, uses) of directives (file, kind, target): the sorted distinct targets of each kind."""
    of = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("target")))), ",")
    return directives.groupBy("file").agg(of("module").alias("modules"), of("import").alias("imports"), of("use").alias("uses"))


def context_maps(directives: DataFrame) -> DataFrame:
    """(file, modules, imports, uses, roles, aliases) of directives (file, kind, target, name, line): sorted distinct targets of each kind, and the aliases by short name, the last line's target counting."""
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("target"))))
    sets = directives.groupBy("file").agg(*(of(k).alias(f"{k}s") for k in ("module", "import", "use", "role")))
    last = directives.where("kind = 'alias' AND name IS NOT NULL").groupBy("file", "name").agg(F.max(F.struct("line", "target")).alias("last"))
    maps = last.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "last.target")))).alias("aliases"))
    return sets.join(maps, "file", "left").withColumn("aliases", F.coalesce("aliases", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))


def project_roles(directives: DataFrame) -> DataFrame:
    """(role, modules, files): the modules and files of each role that a framework gives, sorted; a module has the roles of its file."""
    roles = directives.where("kind = 'role'").select("file", F.col("target").alias("role")).distinct()
    modules = directives.where("kind = 'module'").select("file", F.col("target").alias("module")).distinct()
    return roles.join(modules, "file", "left").groupBy("role").agg(F.array_sort(F.collect_set("module")).alias("modules"), F.array_sort(F.collect_set("file")).alias("files"))


def search_comparison(trials: DataFrame, median) -> DataFrame:  # noqa: ANN001
    """(mode, found, trials, coverage, depth, time) of trials (mode, found, coverage, depth and, if given, time): medians by `median`, which takes (mode, sample) rows."""
    counts = trials.groupBy("mode").agg(F.count_if("found").alias("found"), F.count("*").alias("trials"))
    for name in [c for c in ("coverage", "depth", "time") if c in trials.columns]:
        counts = counts.join(median(trials.select("mode", F.col(name).alias("sample")), ["mode"]).withColumnRenamed("median", name), "mode", "left")
    return counts


def distinct_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of distinct values of each column, and of rows."""
    return rows.agg(F.count("*").alias("rows"), *(F.count_distinct(c).alias(c) for c in columns))


#: Bits of a sketch's registers: the standard error of an estimate is 1.04 / sqrt(2 ** PRECISION), 0.8 percent.
PRECISION = 14


def distinct_sketches(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, rows, a sketch of each column): what can be kept and united later to count distinct values, of 2 ** PRECISION bytes at most, whatever a group holds. Nulls are no values."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), *(F.hll_sketch_agg(c, PRECISION).alias(c) for c in columns))


def merge_sketches(sketches: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Sketches of the same columns united by keys, such as those of days into one of a month."""
    return sketches.groupBy(*keys).agg(F.sum("rows").alias("rows"), *(F.hll_union_agg(c).alias(c) for c in columns))


def sketch_estimates(sketches: DataFrame, columns: list[str]) -> DataFrame:
    """Sketches as numbers of distinct values: within 2.4 percent in 997 of 1000 cases (three standard errors)."""
    return sketches.withColumns({c: F.hll_sketch_estimate(c) for c in columns})


def fact_order(facts: DataFrame) -> DataFrame:
    """facts in their total order: file, line, column (none is zero), kind, object, id."""
    return facts.orderBy("file", "line", F.coalesce("col", F.lit(0)), "kind", "object", "id")


def diagnostic_order(diagnostics: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(c, F.lit(""))
    return diagnostics.orderBy("level", "phase", empty("file"), empty("rule"), "code")


def complete_or_fail(page: DataFrame) -> DataFrame:
    """The rows of a page that is the whole answer; a page with a next offset fails when it is read."""
    whole = F.assert_true(F.col("next_offset").isNull(), F.lit("the answer does not fit one page"))
    return page.where(whole.isNull()).drop("next_offset", "total")


def include_minus_exclude(paths: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Distinct paths (path) that match an including pattern and no excluding one; parts that begin with a dot need a pattern that names them. In patterns `**/` is any folders, `*` and `?` stay within a name."""

    def regex(glob: str) -> str:
        out, i = "", 0
        while i < len(glob):
            if glob.startswith("**/", i):
                out, i = out + r"(?:[^./][^/]*/)*", i + 3
            elif glob[i] == "*":
                out, i = out + (r"(?!\.)" if not out or out.endswith("/") or out.endswith(")*") else "") + r"[^/]*", i + 1
            elif glob[i] == "?":
                out, i = out + "[^/]", i + 1
            else:
                out, i = out + (glob[i] if glob[i].isalnum() or glob[i] in "/_-" else "\\" + glob[i]), i + 1
        return f"^{out}$"

    one_of = lambda globs: reduce(lambda a, b: a | b, (F.col("path").rlike(regex(g)) for g in globs), F.lit(False))
    return paths.select("path").where(one_of(include) & ~one_of(exclude)).distinct()


def replay_shape_equal(first: DataFrame, second: DataFrame, timing: list[str]) -> DataFrame:
    """(id, equal) of two runs' results by id: equal in all columns but those of time; an id of one run alone is not equal."""
    shape = lambda d: d.drop(*timing).select("id", F.to_json(F.struct(*sorted(c for c in d.columns if c not in timing))).alias("shape"))
    a, b = shape(first), shape(second)
    return a.join(b.withColumnRenamed("shape", "other"), "id", "full_outer").select("id", F.coalesce(F.col("shape") == F.col("other"), F.lit(False)).alias("equal"))


def distinct_targets(targets: DataFrame) -> DataFrame:
    """One row per id, the least of each, sorted by id."""
    rest = [c for c in targets.columns if c != "id"]
    return targets.groupBy("id").agg(F.min(F.struct(*rest)).alias("r")).select("id", *(F.col(f"r.{c}").alias(c) for c in rest)).orderBy("id")


def externalize_results(results: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows, artifacts) of results (id, and fields): rows whose JSON is above the limit hold size and digest in its place, and the JSON is an artifact once per digest."""
    text = F.to_json(F.struct(*sorted(results.columns)))
    coded = results.select("id", text.alias("json"), wire_value(text).alias("w"))
    large = F.col("w.size") > limit
    rows = coded.select("id", F.when(~large, F.col("json")).alias("json"), F.when(large, F.col("w.sha256")).alias("sha256"), F.col("w.size").alias("size"))
    return rows, coded.where(large).groupBy(F.col("w.sha256").alias("sha256")).agg(F.min("json").alias("json"))


def wire_projection(findings: DataFrame) -> DataFrame:
    """findings (id, evidence, raw, seed) as what may leave: evidence in valid UTF-8, raw as size and digest, no seed."""
    return findings.select("id", F.make_valid_utf8("evidence").alias("evidence"), wire_value(F.col("raw"))["size"].alias("raw_size"), wire_value(F.col("raw"))["sha256"].alias("raw_sha256"))


#: Inert probes by class, this library's own; mk7 is a word that is easy to find again.
PAYLOADS = {
    "sqli": ("1' AND '1'='2", "0 UNION SELECT NULL,NULL", "1) OR (SELECT 7)=(7", "mk7' OR 'a'<'b"),
    "xss": ("<svg id=mk7 onload=void(0)>", "<img alt=mk7 src=x:>", "javascript:void('mk7')"),
    "path_traversal": ("....//....//mk7.txt", "/..;/mk7.txt", "%252e%252e%252fmk7.txt"),
    "ssrf": ("http://mk7.example/", "http://[::1]:9/mk7", "gopher://mk7.example:9/_x"),
    "command_injection": ("a\necho mk7", "%0Aecho mk7", "a&echo mk7&"),
    "template_injection": ("{{ 'mk' ~ 7 }}", "*{3*3}mk7", "@(3*3)mk7"),
    "http_parameter_injection": ("a=1&a=mk7", "a;b=mk7", "mk7%0d%0aX-Mk7: 1"),
    "ldap_injection": ("*)(uid=mk7", "mk7)(|(cn=*"),
    "xml_entity": ('<!DOCTYPE m [<!ENTITY e "mk7">]><m>&e;</m>',),
    "null_byte": ("mk7%00.png", "mk7\0.png"),
    "malformed_utf8": (b"mk7\xc3(", b"mk7\xe2\x82", b"\xf0(\x8c\xbcmk7"),
    "format_string": ("%08x.%08x.mk7", "{0.__class__}mk7"),
}


def builtin_payloads(spark: SparkSession) -> DataFrame:
    """(class, place, value) of the built-in payloads; values are bytes."""
    rows = [(c, i, v if isinstance(v, bytes) else v.encode()) for c, vs in PAYLOADS.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "class string, place int, value binary")
