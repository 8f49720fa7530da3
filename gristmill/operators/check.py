"""Requirements against resumes: retrieval with narrowing, gates, strengths, coverage and fit; and the holistic round of a whole pair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.dialect import SPARK as D
from gristmill.operators import ask, resume
from gristmill.operators.extract import answer_of
from gristmill.operators.failures import Failures, materialised, settled
from gristmill.operators.prompts import NONE, Prompts
from gristmill.operators.score import match_score, score_fit
from gristmill.plans.dual import run
from gristmill.settings.config import Settings
from gristmill.settings.tuning import Tuning

PAIR = ("posting_id", "resume_id")
CAPPED = ("skills", "summary")
GRADES = ("strong", "partial", "weak")


def evidence_units(resumes: DataFrame) -> DataFrame:
    """(resume_id, ord, id, text, section, role, company, dates) of resumes(resume_id, text)."""
    rows = run(resumes.sparkSession, lambda t: f"SELECT * FROM {resume.units(D, t('docs'))} u_", docs=resumes.select(F.col("resume_id").alias("doc_id"), "text"))
    return rows.withColumnRenamed("doc_id", "resume_id")


def without_mentioned(requirements: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Required and preferred requirements, and the groups that keep two of them."""
    kept = requirements.where(F.col("tier").isin("required", "preferred"))
    rows = groups.select("posting_id", "group_ord", "group_id", F.posexplode("members").alias("place", "id")).join(kept.select("posting_id", "id"), ["posting_id", "id"], "left_semi")
    again = rows.groupBy("posting_id", "group_ord", "group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("members"))
    return kept, again.where(F.size("members") > 1)


def check_requirements(requirements: DataFrame, context: DataFrame) -> DataFrame:
    """(posting_id, req_ord, id, value, tier, option, context): options unique whatever their case, and the shortest sentence of each."""
    refs = requirements.select("posting_id", "id", F.posexplode("refs").alias("place", "ref")).join(context.select("posting_id", "ref", "text"), ["posting_id", "ref"])
    shortest = refs.groupBy("posting_id", "id").agg(F.min_by("text", F.struct(F.octet_length("text"), "place")).alias("context"))
    seen = F.row_number().over(Window.partitionBy("posting_id", F.lower("value")).orderBy("req_ord"))
    option = F.when((seen > 1) | (F.lower("value") == NONE), F.concat("value", F.lit(" ("), "id", F.lit(")"))).otherwise(F.col("value"))
    rows = requirements.withColumn("option", option).join(shortest, ["posting_id", "id"], "left")
    return rows.select("posting_id", "req_ord", "id", "value", "tier", "option", F.coalesce("context", F.lit("")).alias("context"))


def _state(u: Column) -> Column:
    some = lambda c: F.when(c != "", c)
    return F.to_json(F.struct(u["section"].alias("resume_section"), some(u["role"]).alias("role"), some(u["company"]).alias("company"), u["text"].alias("statement")))


def _ranked(probs: Column, options: Column, n: int, floor: float) -> Column:
    """The n likeliest options at the floor or above, ties by name; an absent one counts as 0."""
    # from the entries of the map: to look each option up in it would go with the square of their number
    said = F.transform(F.filter(F.map_entries(probs), lambda e: F.array_contains(options, e["key"])), lambda e: F.struct((-F.coalesce(e["value"], F.lit(0.0))).alias("p"), e["key"].alias("o")))
    rest = F.transform(F.array_except(options, F.map_keys(probs)), lambda o: F.struct((-F.lit(0.0)).alias("p"), o.alias("o")))
    return F.transform(F.slice(F.filter(F.sort_array(F.concat(said, rest)), lambda x: -x["p"] >= floor), 1, n), lambda x: x["o"])


def retrieve(units: DataFrame, offers: DataFrame, provider: ask.Provider, prompts: Prompts, settings: Settings, failures: Failures | None = None) -> DataFrame:
    """units(pair..., unit) with `retrieved`: the options of its posting that a unit may support.

    offers(posting_id, options, contexts): a posting's options once, with the sentence of each or null. A unit carries the places of what it is still
    offered, and meets the options of its posting only to be asked. Each round but the last offers only the likeliest of the round before; one
    option left ends it; the last keeps retrieval_k at the floor or above.
    """
    rows, done = units.withColumn("places", F.lit(None).cast("array<int>")), None
    keep = list(units.columns)
    for size in (*settings.narrow_sizes, 0):
        offered = F.when(F.col("places").isNull(), F.col("options")).otherwise(F.transform("places", lambda i: F.get("options", i)))
        # a unit's row is small and its question large: dealt out by number, or few tasks would be made by bytes
        asked = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "posting_id").join(offers, "posting_id").withColumn("offered", offered)
        question = prompts.retrieval_question(F.lit("retrieval"), F.col("offered"), F.map_filter("contexts", lambda k, v: v.isNotNull() & F.array_contains("offered", k)))
        requests = asked.withColumn("state", _state(F.col("unit"))).withColumn("questions", F.array(question)).drop("options", "contexts")
        # what a round takes from the answers is worked out and written once
        a, offers_ = answer_of(F.lit("retrieval")), F.col("offered")
        fine = F.coalesce((a["choice"] == NONE) | F.array_contains("offered", a["choice"]), F.lit(False)).alias("fine")
        if size:
            place = lambda o: F.when(F.col("places").isNull(), (F.array_position("offered", o) - 1).cast("int")).otherwise(F.get("places", (F.array_position("offered", o) - 1).cast("int")))
            told = lambda best: F.struct(fine, F.size(best).alias("n"), F.when(F.size(best) > 1, F.transform(best, place)).alias("places"), F.when(F.size(best) <= 1, _ranked(a["probs"], offers_, 1, settings.retrieval_floor)).alias("retrieved"))
            taken = F.get(F.transform(F.array(_ranked(a["probs"], offers_, size, 0.0)), told), F.lit(0))
        else:
            taken = F.struct(fine, _ranked(a["probs"], offers_, settings.retrieval_k, settings.retrieval_floor).alias("retrieved"))
        answered = ask.asked(provider, requests, *keep, taken=taken)
        wrong = F.when(~F.col("taken.fine"), F.lit("retrieval: the answer is not an option"))
        answered = settled(answered, F.coalesce(F.col("failed"), wrong, F.col("wrong")), "retrieval", failures)
        ended = answered.where("taken.n <= 1" if size else "true").select(*keep, "taken.retrieved")
        done = ended if done is None else done.unionByName(ended)
        if not size:
            return done
        rows = answered.where("taken.n > 1").select(*keep, "taken.places")
    raise AssertionError("the last round returns")


def _ask_pairs(rows: DataFrame, provider: ask.Provider, name: str, build, failures: Failures | None) -> DataFrame:
    """(pair..., unit_id, k, answer): one request a unit with a question for each of its rows (k, unit, value, context)."""
    packed = rows.groupBy(*PAIR, F.col("unit.id").alias("unit_id")).agg(F.first("unit").alias("unit"), F.array_sort(F.collect_list(F.struct("k", "value", "context"))).alias("items"))
    named = lambda x: F.concat(F.lit(f"{name}_"), x["k"].cast("string"))
    requests = packed.withColumn("state", _state(F.col("unit"))).withColumn("questions", F.transform("items", lambda x: build(named(x), x["value"], x["context"])))
    answered = settled(ask.asked(provider, requests, *PAIR, "unit_id", "items"), F.col("wrong"), name, failures)
    each = answered.select(*PAIR, "unit_id", "answers", F.explode("items").alias("x"))
    return each.select(*PAIR, "unit_id", "x.k", answer_of(named(F.col("x"))).alias("answer"))


def judge_strength(pairs: DataFrame, provider: ask.Provider, prompts: Prompts, settings: Settings, failures: Failures | None = None) -> DataFrame:
    """pairs(pair..., unit, k, id, value, context) with gate, mass, strength, linked, capped and reason.

    The gate decides where there is one; units that only list things are capped at weak, and where the settings say so
    neither they nor pairs behind a closed gate are graded: an ungraded link is weak, with the gate's probability.
    """
    keys = [*PAIR, "unit_id", "k"]
    rows = pairs.withColumn("unit_id", F.col("unit.id")).withColumn("is_capped", F.col("unit.section").isin(*CAPPED))
    gated = settings.gate_threshold > 0
    if gated:  # pairs that failed there have no answers, and go
        rows = rows.join(_ask_pairs(pairs, provider, "gate", prompts.gate_question, failures), keys)
        rows = materialised(rows.withColumn("gate", F.col("answer.noul")).drop("answer"))
    else:
        rows = rows.withColumn("gate", F.lit(None).cast("double"))
    graded = F.lit(True)
    if gated and settings.skip_capped_grading:
        graded = graded & ~F.col("is_capped")
    if gated and settings.gate_first:
        graded = graded & (F.col("gate") >= settings.gate_threshold)
    said = _ask_pairs(rows.where(graded).select(*PAIR, "unit", "k", "value", "context"), provider, "req", prompts.strength_question, failures)
    rows = rows.join(said, keys, "left")
    rows = failures.without(rows) if failures else rows
    known = F.col("answer").isNotNull()
    wrong = F.when(known & ~F.coalesce(F.col("answer.choice").isin(*prompts.strengths), F.lit(False)), F.concat(F.lit("not a strength for "), F.col("value")))
    rows = settled(rows, wrong, "strength", failures).withColumn("probs", F.col("answer.probs")).withColumn("graded", known)
    grades = F.array(*[F.lit(g) for g in GRADES])
    best = F.coalesce(ask.argmax(F.col("probs"), grades), F.lit("strong"))
    rows = rows.withColumn("mass", F.when(F.col("graded"), ask.mass(F.col("probs"), grades)).otherwise(F.col("gate") if gated else F.lit(0.0)))
    rows = rows.withColumn("best", F.when(F.col("graded"), best).otherwise(F.lit("weak")))
    linked = F.col("gate") >= settings.gate_threshold if gated else F.col("mass") >= settings.evidence_mass
    others = F.array_sort(F.array_except(F.map_keys("probs"), grades))
    top = F.array_max(F.transform(others, lambda o: ask.p(F.col("probs"), o)))
    reason = F.when(~F.col("graded"), "gate").otherwise(F.coalesce(F.get(F.filter(others, lambda o: ask.p(F.col("probs"), o) == top), F.lit(0)), F.lit("none")))
    rows = rows.withColumn("linked", linked).withColumn("capped", F.col("linked") & F.col("is_capped") & (F.col("best") != "weak"))
    strength = F.when(F.col("linked"), F.when(F.col("is_capped"), "weak").otherwise(F.col("best")))
    return rows.select(*PAIR, "unit", "unit_id", "k", "id", "value", "gate", "mass", strength.alias("strength"), "linked", "capped", F.when(~F.col("linked"), reason).alias("reason"))


@dataclass
class Coverage:
    #: (posting_id, resume_id, req_ord, id, value, tier, coverage, evidence)
    requirements: DataFrame
    #: (posting_id, resume_id, group_ord, group_id, members, coverage)
    groups: DataFrame
    #: (posting_id, resume_id, score, by_tier, gaps)
    fit: DataFrame
    #: (posting_id, resume_id, id, text, section, role, company, dates): units that some link refers to
    units: DataFrame
    #: (posting_id, resume_id, unit_id, id, strength, p, gate, linked, capped, reason): every judged pair
    judged: DataFrame
    #: (posting_id, resume_id, stage, error, rows): pairs that were lost on the way, none in a strict run
    failures: DataFrame | None = None


def _rank(strength: Column) -> Column:
    return F.when(strength == "strong", 3).when(strength == "partial", 2).when(strength == "weak", 1).otherwise(0)


def fit_weights(tuning: Tuning) -> dict:
    """What score_fit takes from a tuning."""
    return {"credit": tuning["fit_score"]["credit"], "tier_weight": tuning["fit_score"]["tier_weight"]}


def build_coverage(pairs: DataFrame, requirements: DataFrame, groups: DataFrame, judged: DataFrame, tuning: Tuning) -> Coverage:
    """The best link of every requirement, evidence strongest first, groups by their best member, and the Fit Score."""
    links = judged.where("linked").withColumn("r", _rank(F.col("strength")))
    told = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("r"), (-F.col("mass")).alias("p"), F.col("unit.ord").alias("o"), F.struct(F.col("unit_id").alias("unit"), "strength", F.col("mass").alias("p")).alias("e")))), lambda x: x["e"])
    best = links.groupBy(*PAIR, "id").agg(told.alias("evidence"))
    each = pairs.select(*PAIR).join(requirements.select("posting_id", "req_ord", "id", "value", "tier"), "posting_id").join(best, [*PAIR, "id"], "left")
    nothing = F.array().cast("array<struct<unit:string,strength:string,p:double>>")
    each = each.withColumn("evidence", F.coalesce("evidence", nothing)).withColumn("coverage", F.coalesce(F.get("evidence", F.lit(0))["strength"], F.lit("none")))
    each = materialised(each.select(*PAIR, "req_ord", "id", "value", "tier", "coverage", "evidence"))
    members = groups.select("posting_id", "group_ord", "group_id", "members", F.explode("members").alias("id")).join(each.select(*PAIR, "id", "coverage"), ["posting_id", "id"])
    sums = members.groupBy(*PAIR, "group_ord", "group_id", "members").agg(F.max_by("coverage", _rank(F.col("coverage"))).alias("coverage"))
    pair = F.struct(*PAIR)
    fit = score_fit(each.select(pair.alias("pair"), "req_ord", F.col("id").alias("req_id"), "tier", "coverage"), members.select(pair.alias("pair"), "group_ord", "group_id", F.col("id").alias("member_id")), **fit_weights(tuning))
    fit = pairs.select(*PAIR).join(fit.select("pair.*", F.col("fit").alias("score"), "by_tier", "gaps"), list(PAIR), "left")
    units = links.select(*PAIR, "unit.*").dropDuplicates([*PAIR, "id"])
    return Coverage(each, sums, fit, units, judged)


def retrieval_space(asked: DataFrame) -> DataFrame:
    """(posting_id, options, contexts): the options of check_requirements in order, and the sentence of each, null where there is none."""
    offers = asked.groupBy("posting_id").agg(F.array_sort(F.collect_list(F.struct("req_ord", "option", "context"))).alias("o"))
    return offers.select("posting_id", F.transform("o", lambda x: x["option"]).alias("options"), F.map_from_entries(F.transform("o", lambda x: F.struct(x["option"], F.when(x["context"] != "", x["context"])))).alias("contexts"))


def check(pairs: DataFrame, requirements: DataFrame, groups: DataFrame, context: DataFrame, resumes: DataFrame, provider: ask.Provider, tuning: Tuning, settings: Settings | None = None, strict: bool = True) -> Coverage:
    """pairs(posting_id, resume_id): every resume's evidence units against every requirement of the posting.

    strict: a wrong answer fails the job; else it loses its pair, and `failures` says why.
    """
    settings, prompts = settings or Settings(), Prompts(tuning)
    failures = None if strict else Failures(*PAIR)
    if settings.skip_mentioned:
        requirements, groups = without_mentioned(requirements, groups)
    asked = materialised(check_requirements(requirements, context))
    offers = materialised(retrieval_space(asked))
    units = evidence_units(resumes).select("resume_id", F.struct("ord", "id", "text", "section", "role", "company", "dates").alias("unit"))
    rows = pairs.select(*PAIR).join(units, "resume_id").join(offers.select("posting_id"), "posting_id", "left_semi").select(*PAIR, "unit")
    found = materialised(retrieve(rows, offers, provider, prompts, settings, failures))
    each = found.select(*PAIR, "unit", F.posexplode("retrieved").alias("k", "option")).join(asked.select("posting_id", "id", "value", "option", "context"), ["posting_id", "option"])
    judged = materialised(judge_strength(each.select(*PAIR, "unit", "k", "id", "value", "context"), provider, prompts, settings, failures))
    if failures:
        pairs, judged = failures.without(pairs), failures.without(judged)
    out = build_coverage(pairs, requirements, groups, judged, tuning)
    out.failures = failures.table(pairs.sparkSession) if failures else None
    return out


def coverage_json(c: Coverage, model: str = "") -> DataFrame:
    """(posting_id, resume_id, coverage): schema version 1 as JSON text."""
    listed = lambda rows, order, *cols: rows.groupBy(*PAIR).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*cols).alias("x")))), lambda y: y["x"]).alias("l"))
    reqs = listed(c.requirements, "req_ord", "id", "value", "tier", "coverage", "evidence").withColumnRenamed("l", "requirements")
    groups = listed(c.groups, "group_ord", F.col("group_id").alias("id"), "members", "coverage").withColumnRenamed("l", "alternative_groups")
    unit = F.struct("id", "text", F.col("section").alias("resume_section"), "role", "company", "dates")
    units = c.units.groupBy(*PAIR).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", unit.alias("u"))))).alias("evidence_units"))
    rows = c.fit.withColumn("fit", F.struct("score", "by_tier", "gaps")).join(reqs, list(PAIR), "left").join(groups, list(PAIR), "left").join(units, list(PAIR), "left")
    some = lambda n, text: F.coalesce(F.col(n), F.from_json(F.lit(text), rows.schema[n].dataType)).alias(n)
    body = F.struct(F.lit("1").alias("schema_version"), F.lit(model).alias("model"), some("requirements", "[]"), some("alternative_groups", "[]"), "fit", some("evidence_units", "{}"))
    return rows.select(*PAIR, F.to_json(body, {"ignoreNullFields": "false"}).alias("coverage"))


def holistic(pairs: DataFrame, provider: ask.Provider, tuning: Tuning, strict: bool = True) -> DataFrame:
    """(pair columns..., role_match, experience_short, blocker, match_score): three questions over each whole pair.

    pairs: any columns with posting (as the extractor reads it) and resume texts. A missing answer fails the job; if not strict, its pair has no
    score and says why in `error`.
    """
    prompts = Prompts(tuning)
    keys = [c for c in pairs.columns if c not in ("posting", "resume")]
    requests = pairs.select(*keys, F.to_json(F.struct(F.col("posting").alias("job_posting"), "resume")).alias("state"), prompts.holistic_questions().alias("questions"))
    answered = ask.asked(provider, requests, *keys)
    parts = [("role_match", "score"), ("experience_short", "noul"), ("blocker", "noul")]
    said = {id: answer_of(F.lit(id))[field] for id, field in parts}
    none = F.coalesce(*[F.when(said[id].isNull(), F.lit(f"{id}: no {field} answer")) for id, field in parts])
    wrong = F.coalesce(F.col("failed"), none, F.col("wrong"))
    rows = settled(answered, wrong, "holistic", None) if strict else answered.withColumn("error", wrong)
    kept = lambda c: c if strict else F.when(F.col("error").isNull(), c)
    scale = {"role_match": len(prompts.role_match["levels"]) - 1}
    rows = rows.select(*keys, *[kept(said[id] / scale.get(id, 1)).alias(id) for id, _ in parts], *([] if strict else ["error"]))
    weights = tuple(tuning["match_score"][k] for k in ("intercept", "role_match", "experience_short"))
    return rows.withColumn("match_score", match_score(F.col("role_match"), F.col("experience_short"), F.col("blocker"), weights))


def match_json(scored: DataFrame, tuning: Tuning, model: str = "") -> DataFrame:
    """The keys of scored with `match`: schema version 1 as JSON text."""
    signals = ("role_match", "experience_short", "blocker")
    keys = [c for c in scored.columns if c not in (*signals, "match_score", "error")]
    body = F.struct(F.lit("1").alias("schema_version"), F.lit(model).alias("model"), F.lit(tuning.hash).alias("tuning"), "match_score", F.struct(*signals).alias("signals"))
    return scored.select(*keys, F.to_json(body).alias("match"))
