"""Postings to requirements: sections, candidates, validation, refinement, result.

Every round builds requests, asks a provider once and decides by plain expressions; what a provider said is written, so nothing is
asked twice. Postings run side by side: a key holds what one posting holds. With a table of failures a wrong answer loses its posting alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import lexicon as X
from gristmill.functions import text as T
from gristmill.functions.dialect import SPARK as D
from gristmill.operators import ask, refine
from gristmill.operators import candidates as C
from gristmill.operators.failures import Failures, materialised, settled
from gristmill.operators.prompts import KEEP, Prompts
from gristmill.settings.config import Settings
from gristmill.settings.tuning import SECTIONS, Tuning

DROPPED = ("company", "benefits", "other")
KEEP_MASS, MERGE_MASS, ALTERNATIVE_MASS = X.KEEP_MASS, X.LINK_MASS, X.LINK_MASS
Generator = Callable[[DataFrame], DataFrame]


def prepared(postings: DataFrame) -> DataFrame:
    """(posting_id, title, text): the title is the first line that says something; below a full-description marker only that is read."""
    return postings.select("posting_id", F.expr(T.title(D, "text")).alias("title"), F.expr(T.posting_text(D, "text")).alias("text"))


def answer_of(id: Column) -> Column:
    return F.get(F.filter("answers", lambda a: a["id"] == id), F.lit(0))


def section_batches(postings: DataFrame, batch: int = X.SECTION_BATCH) -> DataFrame:
    """(posting_id, title, posting, batch, part): a posting's sentences in order, `batch` at a time; postings without any have no row."""
    said = C.not_empty(C.with_sentences(postings).select("posting_id", "title", F.col("text").alias("posting"), "sentences"), "sentences")
    cut = said.withColumn("batch", F.explode(F.expr(f"sequence(0, (size(sentences) - 1) div {batch})")))
    return cut.withColumn("part", F.expr(f"slice(sentences, CAST(batch AS INT) * {batch} + 1, {batch})")).drop("sentences")


def label_sections(postings: DataFrame, provider: ask.Provider, prompts: Prompts, batch: int = X.SECTION_BATCH, failures: Failures | None = None) -> DataFrame:
    """(posting_id, ord, ref, text, heading, strong, section, confidence): a choice for every sentence, `batch` a request."""
    parts = section_batches(postings, batch)
    name = lambda s: F.concat(F.lit("section_"), (s["ord"] - 1).cast("string"))
    requests = parts.select("posting_id", "batch", "part", F.to_json(F.struct(F.col("title").alias("job_title"), F.col("posting").alias("job_posting"))).alias("state"), F.transform("part", lambda s: prompts.section_question(name(s), s["text"], s["heading"])).alias("questions"))
    answered = ask.asked(provider, requests, "posting_id", "part")
    each = answered.select("posting_id", "answers", "failed", "wrong", F.explode("part").alias("s")).withColumn("a", answer_of(name(F.col("s"))))
    unknown = F.concat(F.lit("sentence "), F.col("s.ref"), F.lit(": unknown section "), F.coalesce(F.col("a.choice"), F.lit("none")))
    wrong = F.when(~F.coalesce(F.col("a.choice").isin(*SECTIONS), F.lit(False)), unknown)
    good = settled(each, F.coalesce(F.col("failed"), wrong, F.col("wrong")), "sections", failures)
    return good.select("posting_id", "s.*", F.col("a.choice").alias("section"), F.col("a.confidence").alias("confidence"))


def job_summary(postings: DataFrame, labelled: DataFrame, generator: Generator | None = None) -> DataFrame:
    """(posting_id, title, summary, fallback): what the generator says, cut to SUMMARY_RUNES, or the title and the required and preferred sentences.

    generator: from (posting_id, text) to (posting_id, said), null or blank where it fails.
    """
    wanted = F.when(F.col("section").isin("required", "preferred"), F.struct("ord", F.trim("text").alias("text")))
    told = labelled.groupBy("posting_id").agg(F.array_sort(F.collect_list(wanted)).alias("told"))
    rows = postings.select("posting_id", "title", "text").join(told, "posting_id", "left")
    ended = lambda s: F.when((s != "") & ~s.rlike("[.!?]$"), F.concat(s, F.lit("."))).otherwise(s)
    rows = rows.withColumn("f_", F.array_join(F.concat(F.array(ended(F.trim("title"))), F.coalesce(F.transform("told", lambda x: ended(x["text"])), F.array().cast("array<string>"))), " "))
    rows = rows.withColumn("f_", F.trim(F.expr(T.truncate_words(D, "f_", X.FALLBACK_RUNES))))
    if generator is None:
        return rows.select("posting_id", "title", F.col("f_").alias("summary"), F.lit(True).alias("fallback"))
    rows = rows.join(generator(postings.select("posting_id", "text")).select("posting_id", F.trim("said").alias("g_")), "posting_id", "left")
    good = F.coalesce(F.col("g_") != "", F.lit(False))
    return rows.select("posting_id", "title", F.when(good, F.trim(F.expr(T.truncate_words(D, "g_", X.SUMMARY_RUNES)))).otherwise(F.col("f_")).alias("summary"), (~good).alias("fallback"))


def generate_candidates(labelled: DataFrame, longest: int = X.MAX_WINDOW, skip_responsibilities: bool = False) -> DataFrame:
    """(posting_id, ord, ref, section, sentence, chunk_no, chunk, options) of the sentences whose section is kept and that are no strong heading."""
    dropped = (*DROPPED, "responsibilities") if skip_responsibilities else DROPPED
    kept = labelled.where(~F.col("section").isin(*dropped) & ~F.col("strong")).select("posting_id", "ord", "ref", "section", F.col("text").alias("sentence"), F.expr(T.strip_label(D, "text")).alias("text"))
    found = C.not_empty(C.with_options(C.chunks(kept), longest=longest), "options")
    return found.withColumnRenamed("text", "chunk").select("posting_id", "ord", "ref", "section", "sentence", "chunk_no", "chunk", "options")


def validation_round(chunks: DataFrame, summaries: DataFrame, provider: ask.Provider, prompts: Prompts, least: float = X.REQUIREMENT_MASS, batch: int = X.VALIDATION_BATCH, failures: Failures | None = None) -> DataFrame:
    """(posting_id, ord, ref, section, sentence, chunk_no, chunk, options, mass, best, best_p, selected, reason, parts): a choice for every chunk.

    A chunk is accepted where its options together hold `least`; parts are the names that its best option stands for.
    """
    place = F.row_number().over(Window.partitionBy("posting_id", "ord").orderBy("chunk_no")) - 1
    rows = chunks.withColumn("n", place).withColumn("batch", F.floor(F.col("n") / batch))
    packed = rows.groupBy("posting_id", "ord", "batch").agg(F.first("ref").alias("ref"), F.first("section").alias("section"), F.first("sentence").alias("sentence"), F.array_sort(F.collect_list(F.struct("n", "chunk_no", "chunk", "options"))).alias("items"))
    name = lambda x: F.concat(F.lit("chunk_"), (x["n"] % batch).cast("string"))
    state = F.to_json(F.struct(F.col("summary").alias("job_summary"), "section", "sentence"))
    requests = packed.join(summaries.select("posting_id", "summary"), "posting_id").withColumn("state", state).withColumn("questions", F.transform("items", lambda x: prompts.validation_question(name(x), x["chunk"], x["options"])))
    answered = ask.asked(provider, requests.drop("summary"), "posting_id", "ord", "ref", "section", "sentence", "items")
    each = answered.select("posting_id", "ord", "ref", "section", "sentence", "answers", "failed", "wrong", F.explode("items").alias("x")).withColumn("a", answer_of(name(F.col("x"))))
    probs, options, rejects = F.col("a.probs"), F.col("x.options"), F.array(*[F.lit(r) for r in sorted(prompts.validation["reject_options"])])
    offered = F.array_contains(F.concat(options, rejects), F.col("a.choice")) & F.map_contains_key(probs, F.col("a.choice"))
    wrong = F.when(~F.coalesce(offered, F.lit(False)), F.concat(F.lit("chunk "), F.col("x.chunk"), F.lit(": the answer is not an option")))
    each = settled(each, F.coalesce(F.col("failed"), wrong, F.col("wrong")), "validation", failures)
    out = each.select("posting_id", "ord", "ref", "section", "sentence", "x.chunk_no", "x.chunk", "x.options", F.col("a.choice").alias("choice"), ask.mass(probs, options).alias("mass"), ask.argmax(probs, options).alias("best"), probs.alias("probs"))
    out = out.withColumn("best_p", ask.p(F.col("probs"), F.col("best"))).withColumn("ok", (F.col("mass") >= least) & F.col("best").isNotNull())
    single = ~F.col("best").rlike("[ \t]") & F.col("best").contains("/") & F.forall(F.split("best", "/"), lambda s: (F.length(s) >= 3) & s.rlike("\\p{L}"))
    parts = F.when(F.col("ok"), F.when(single, F.split("best", "/")).otherwise(F.array("best")))
    top = F.array_max(F.transform(rejects, lambda r: ask.p(F.col("probs"), r)))
    reason = F.when(~F.col("ok"), F.get(F.filter(rejects, lambda r: ask.p(F.col("probs"), r) == top), F.lit(0)))
    return out.select("posting_id", "ord", "ref", "section", "sentence", "chunk_no", "chunk", "options", "mass", "best", "best_p", F.col("ok").alias("selected"), reason.alias("reason"), parts.alias("parts"))


def accepted(validated: DataFrame) -> DataFrame:
    """(posting_id, seq, ref, section, sentence, ord, text, p): a row for each selected name, in order."""
    each = validated.where("selected").select("posting_id", "ord", "ref", "section", "sentence", "chunk_no", F.col("best_p").alias("p"), F.posexplode("parts").alias("part", "text"))
    return each.select("posting_id", F.struct("ord", "chunk_no", "part").alias("seq"), "ref", "section", "sentence", "ord", "text", "p")


def without_titles(found: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): values that are a fragment of the posting's title go."""
    rows = found.join(postings.select("posting_id", "title"), "posting_id")
    rows = rows.withColumn("v_", F.expr(T.title_words(D, "text"))).withColumn("t_", F.expr(T.title_words(D, "title"))).withColumn("drop_", F.expr(T.is_title_fragment(D, "v_", "t_")))
    return rows.where("NOT drop_").select(*found.columns), rows.where("drop_").groupBy("posting_id", F.lower("text").alias("key")).agg(F.min_by("text", "seq").alias("value"))


def unique_values(found: DataFrame) -> DataFrame:
    """(posting_id, i, key, value, first, mentions): values unique by lower case, the first spelling, and the sentences that mention each."""
    told = F.array_sort(F.collect_set(F.struct("ord", "ref", "section", "sentence")))
    rows = found.groupBy("posting_id", F.lower("text").alias("key")).agg(F.min_by("text", "seq").alias("value"), F.min("seq").alias("first"), told.alias("mentions"))
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("posting_id").orderBy("first")) - 1)


def refinement_requests(values: DataFrame, states: DataFrame, prompts: Prompts, skip_importance: bool = False, all_pairs: int = X.ALL_PAIRS, limit: int = X.REFINEMENT_BYTES) -> DataFrame:
    """(posting_id, batch, state, questions, vs): filler, importance, duplicate and alternative questions of every value, by id, in requests
    whose questions together stay under `limit` characters. states: (posting_id, state).

    All other values are offered as duplicates up to `all_pairs` of them, beyond that the similar ones; those of the same sentences as alternatives.
    vs (i, value, mentions_n) stands in the first request of a posting. All of it is built inside the row of a posting: only its values are shuffled.
    """
    packed = values.groupBy("posting_id").agg(F.array_sort(F.collect_list(F.struct("i", "value", "mentions"))).alias("vs"))
    told = lambda m: F.transform(m, lambda x: F.struct(x["section"].alias("section"), x["sentence"].alias("sentence")))
    gram = lambda s: T.trigrams(D, f"lower({s})")
    near = f"transform(filter(vs, x -> x.i <> v.i AND (size(vs) <= {all_pairs} OR {T.similar(D, 'v.value', 'x.value', gram('v.value'), gram('x.value'))})), x -> x.value)"
    beside = "transform(array(v.mentions.ref), refs -> transform(filter(vs, x -> x.i <> v.i AND arrays_overlap(x.mentions.ref, refs)), x -> x.value))[0]"
    each = packed.join(states, "posting_id").withColumn("each_", F.expr(f"transform(vs, v -> named_struct('i', v.i, 'value', v.value, 'mentions', v.mentions, 'near', {near}, 'beside', {beside}))"))

    def asked(v: Column) -> Column:
        named, about = (lambda k: F.concat(F.lit(f"{k}_"), v["i"].cast("string"))), told(v["mentions"])
        link = lambda k, what, offers: F.when(F.size(offers) > 0, prompts.linking_question(what, named(k), v["value"], about, offers))
        some = [prompts.filler_question(named("filler"), v["value"], about), link("dup", "duplicate", v["near"]), link("alt", "alternative", v["beside"])]
        return F.array(*some, *([] if skip_importance else [prompts.importance_question(named("importance"), v["value"], about)]))

    each = each.withColumn("qs", F.sort_array(F.filter(F.flatten(F.transform("each_", asked)), lambda q: q.isNotNull())))
    # questions that fit together need no sizes of their own
    starts = refine.batch_starts(F.transform("qs", lambda q: F.length(F.to_json(q))), limit)
    each = each.withColumn("at_", F.when((F.size("qs") > 0) & (F.length(F.to_json("qs")) <= limit), F.array(F.lit(0))).otherwise(starts))
    small = F.expr("transform(vs, v -> named_struct('i', v.i, 'value', v.value, 'mentions_n', size(v.mentions)))")
    # an outer explode: the filter of a plain one would work all of this out a second time
    cut = each.select("posting_id", "state", "qs", "at_", small.alias("vs"), F.posexplode_outer("at_").alias("batch", "from_")).where("batch IS NOT NULL")
    part = F.slice("qs", F.col("from_") + 1, F.coalesce(F.get("at_", F.col("batch") + 1), F.size("qs")) - F.col("from_"))
    return cut.select("posting_id", "batch", "state", part.alias("questions"), F.when(F.col("batch") == 0, F.col("vs")).alias("vs"))


def _linked(probs: Column, options: Column, reasons: list[str], least: float) -> Column:
    """The value that an answer points to: the likeliest one (ties by name) if the values together hold `least`."""
    named = F.array_except(options, F.array(*[F.lit(r) for r in reasons]))
    best = F.array_min(F.transform(named, lambda o: F.when(ask.p(probs, o) > 0, F.struct((-ask.p(probs, o)).alias("p"), o.alias("o")))))
    return F.when(ask.mass(probs, named) >= least, best["o"])


@dataclass
class Refined:
    #: (posting_id, i, value, mentions_n, keep, keep_p, filler, duplicate_of, alternative_of, canonical, importance)
    values: DataFrame
    #: (posting_id, group_no, members): indexes of canonical values, in order
    groups: DataFrame


def refinement_round(values: DataFrame, summaries: DataFrame, provider: ask.Provider, prompts: Prompts, skip_importance: bool = False, failures: Failures | None = None) -> Refined:
    """Drops filler, merges values that name each other as duplicates, groups alternatives, and weighs importance."""
    states = summaries.select("posting_id", F.to_json(F.struct(F.col("title").alias("job_title"), F.col("summary").alias("job_summary"))).alias("state"))
    kinds, levels = prompts.refinement, len(prompts.importance_levels)
    reasons = sorted(kinds["filler"]["reasons"])

    def decided(q: Column, ids: Column) -> Column:
        """(what, i, keep_p, filler, link, own): what is taken from the answer to a question; its text needn't be written."""
        parts = F.split(q["id"], "_(?=[0-9]+$)")

        def said(x: Column) -> Column:
            a, what, i = x["a"], F.get(x["parts"], F.lit(0)), F.get(x["parts"], F.lit(1)).cast("int")
            probs = a["probs"]
            keep_p, top = ask.p(probs, KEEP), F.array_max(F.array(*[ask.p(probs, r) for r in reasons]))
            filler = F.when((what == "filler") & (keep_p < KEEP_MASS), F.coalesce(*[F.when(ask.p(probs, r) == top, r) for r in reasons]))
            link = F.when(what == "dup", _linked(probs, q["options"], list(kinds["duplicate"]["reasons"]), MERGE_MASS)).when(what == "alt", _linked(probs, q["options"], list(kinds["alternative"]["reasons"]), ALTERNATIVE_MASS))
            own = F.when(what == "importance", a["score"] / (levels - 1))
            return F.struct(what.alias("what"), i.alias("i"), F.when(what == "filler", keep_p).alias("keep_p"), filler.alias("filler"), link.alias("link"), own.alias("own"))

        return ask.bound(F.struct(ask.found(q["id"], ids).alias("a"), parts.alias("parts")), lambda x: F.when(x["a"].isNotNull(), said(x)))

    requests = refinement_requests(values, states, prompts, skip_importance)
    answered = ask.asked(provider, requests, "posting_id", "vs", taken=ask.bound(F.transform("answers", lambda a: a["id"]), lambda ids: F.transform("questions", lambda q: decided(q, ids))))
    answered = settled(answered, F.col("wrong"), "refinement", failures)
    # a posting's values and decisions meet in one row; a value has one decision of each kind
    whole = answered.groupBy("posting_id").agg(F.first("vs", ignorenulls=True).alias("vs"), F.flatten(F.collect_list("taken")).alias("ds"))
    whole = whole.withColumn("ids_", F.expr("transform(ds, d -> concat(d.what, '_', CAST(d.i AS STRING)))"))
    one = lambda k: f"get(ds, CAST(array_position(ids_, concat('{k}_', CAST(v.i AS STRING))) AS INT) - 1)"
    own = "0D" if skip_importance else f"{one('importance')}.own"
    fields = f"'i', v.i, 'value', v.value, 'mentions_n', v.mentions_n, 'f', {one('filler')}, 'dup_of', {one('dup')}.link, 'alt_of', {one('alt')}.link, 'own', {own}"
    whole = whole.withColumn("rs", F.expr(f"transform(vs, v -> named_struct({fields}))"))
    kept = "r.f.keep_p >= " + repr(KEEP_MASS)
    fields = f"'i', r.i, 'value', r.value, 'mentions_n', r.mentions_n, 'keep', {kept}, 'keep_p', r.f.keep_p, 'filler', r.f.filler, 'dup_of', r.dup_of, 'alt_of', r.alt_of, 'own', if({kept}, r.own, NULL)"
    whole = whole.withColumn("rs", F.expr(f"transform(rs, r -> named_struct({fields}))"))
    # two kept values that name each other: more mentions stand, then the earlier one
    twin = "get(filter(rs, x -> x.keep AND r.keep AND x.value = r.dup_of AND x.dup_of = r.value), 0)"
    theirs = "t IS NOT NULL AND (t.mentions_n > r.mentions_n OR (t.mentions_n = r.mentions_n AND t.i < r.i))"
    whole = whole.withColumn("cs", F.expr(f"transform(transform(rs, r -> named_struct('r', r, 't', {twin})), p -> transform(array(p.r), r -> transform(array(p.t), t -> if({theirs}, t.i, r.i))[0])[0])"))
    pairs = "arrays_zip(rs, cs)"
    best = "array_max(transform(filter(zs, y -> y.cs = z.cs), y -> y.rs.own))"
    other = "get(filter(zs, y -> z.rs.keep AND y.rs.keep AND y.rs.value = z.rs.alt_of AND y.cs <> z.cs), 0).cs"
    whole = whole.select("posting_id", F.expr(pairs).alias("zs"))
    each = whole.select("posting_id", F.explode_outer(F.expr(f"transform(zs, z -> named_struct('r', z.rs, 'canonical', z.cs, 'importance', {best}, 'beside', {other}))")).alias("x")).where("x IS NOT NULL")
    rows = materialised(each.select("posting_id", "x.r.*", "x.canonical", "x.importance", "x.beside"))
    alt = rows.where("beside IS NOT NULL").select("posting_id", F.col("canonical").alias("a"), F.col("beside").alias("b"))
    rows = rows.drop("beside")
    sets = refine.components(alt, "posting_id").groupBy("posting_id", "component").agg(F.array_sort(F.collect_set("node")).alias("members"))
    numbered = sets.withColumn("group_no", F.row_number().over(Window.partitionBy("posting_id").orderBy("component"))).select("posting_id", "group_no", "members")
    return Refined(rows, numbered)


@dataclass
class Extraction:
    #: (posting_id, req_ord, id, value, refs, tier, importance)
    requirements: DataFrame
    #: (posting_id, group_ord, group_id, members)
    groups: DataFrame
    #: (posting_id, ref, ord, text, section)
    context: DataFrame
    labelled: DataFrame
    validated: DataFrame
    refined: Refined | None = None
    title_drops: DataFrame | None = None
    #: (posting_id, stage, error, rows): postings that were lost on the way, none in a strict run
    failures: DataFrame | None = None


def build_result(found: DataFrame, values: DataFrame, refined: Refined, labelled: DataFrame) -> Extraction:
    """Requirements by importance, then first mention; the tier of the strongest section; groups of two or more; the sentences they refer to."""
    names = refined.values.where("keep").select("posting_id", "i", "canonical", "importance")
    final = refined.values.select("posting_id", F.col("i").alias("canonical"), F.col("value").alias("final"))
    rows = found.withColumn("key", F.lower("text")).join(values.select("posting_id", "key", "i"), ["posting_id", "key"]).join(names, ["posting_id", "i"]).join(final, ["posting_id", "canonical"])
    rank = F.when(F.col("section") == "required", 2).when(F.col("section") == "preferred", 1).otherwise(0)
    reqs = rows.groupBy("posting_id", "canonical", F.col("final").alias("value")).agg(F.min("seq").alias("first"), F.max("importance").alias("importance"), F.array_sort(F.collect_set(F.struct("ord", "ref"))).alias("refs"), F.max(rank).alias("rank"))
    place = F.row_number().over(Window.partitionBy("posting_id").orderBy(F.col("importance").desc(), "first"))
    tier = F.when(F.col("rank") == 2, "required").when(F.col("rank") == 1, "preferred").otherwise("mentioned")
    reqs = reqs.withColumn("req_ord", place).withColumn("id", F.concat(F.lit("req_"), F.col("req_ord").cast("string"))).withColumn("tier", tier).withColumn("refs", F.transform("refs", lambda x: x["ref"]))
    reqs = materialised(reqs.select("posting_id", "req_ord", "id", "value", "refs", "tier", "importance", "canonical"))
    members = refined.groups.select("posting_id", "group_no", F.posexplode("members").alias("place", "canonical")).join(reqs.select("posting_id", "canonical", "id"), ["posting_id", "canonical"])
    groups = members.groupBy("posting_id", "group_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("members")).where(F.size("members") > 1)
    groups = groups.select("posting_id", F.col("group_no").alias("group_ord"), F.concat(F.lit("alt_"), F.col("group_no").cast("string")).alias("group_id"), "members")
    used = reqs.select("posting_id", F.explode("refs").alias("ref")).distinct()
    context = labelled.select("posting_id", "ref", "ord", "text", "section").join(used, ["posting_id", "ref"], "left_semi")
    return Extraction(reqs.drop("canonical"), groups, context, labelled, rows)


def extract(postings: DataFrame, provider: ask.Provider, tuning: Tuning, settings: Settings | None = None, generator: Generator | None = None, strict: bool = True) -> Extraction:
    """All seven stages over postings(posting_id, text). strict: a wrong answer fails the job; else it loses its posting, and `failures` says why."""
    settings, prompts = settings or Settings(), Prompts(tuning)
    failures = None if strict else Failures("posting_id")
    docs = prepared(postings)
    labelled = label_sections(docs, provider, prompts, settings.section_batch, failures)
    summaries = materialised(job_summary(docs, labelled, generator))
    chunks = generate_candidates(labelled, settings.max_window_words, settings.skip_responsibilities)
    validated = validation_round(chunks, summaries, provider, prompts, settings.requirement_mass, failures=failures)
    found, drops = without_titles(accepted(validated), docs)
    values = materialised(unique_values(found))
    refined = refinement_round(values, summaries, provider, prompts, settings.skip_importance, failures)
    if failures:  # what a stage gave before a later one lost the posting
        found, labelled, validated, drops = (failures.without(df) for df in (found, labelled, validated, drops))
    out = build_result(found, values, refined, labelled)
    out.validated, out.refined, out.title_drops = validated, refined, drops
    out.failures = failures.table(postings.sparkSession) if failures else None
    return out


def result_json(e: Extraction, model: str = "", importance_skipped: bool = False) -> DataFrame:
    """(posting_id, result): schema version 1 as JSON text."""
    reqs = e.requirements.groupBy("posting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("req_ord", F.struct("id", "value", "refs", "tier", "importance").alias("r")))), lambda x: x["r"]).alias("requirements"))
    groups = e.groups.groupBy("posting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("group_ord", F.struct(F.col("group_id").alias("id"), "members").alias("g")))), lambda x: x["g"]).alias("alternative_groups"))
    context = e.context.groupBy("posting_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ref", F.struct("text", "section").alias("s")))), lambda x: F.struct(x["ref"], x["s"]))).alias("context"))
    postings = e.labelled.select("posting_id").distinct()
    rows = postings.join(reqs, "posting_id", "left").join(groups, "posting_id", "left").join(context, "posting_id", "left")
    some = lambda c, kind: F.coalesce(c, F.from_json(F.lit("[]" if kind == "a" else "{}"), rows.schema[c].dataType)).alias(c)
    skipped = [F.lit(True).alias("importance_skipped")] if importance_skipped else []
    return rows.select("posting_id", F.to_json(F.struct(F.lit("1").alias("schema_version"), F.lit(model).alias("model"), some("requirements", "a"), some("alternative_groups", "a"), some("context", "m"), *skipped)).alias("result"))
