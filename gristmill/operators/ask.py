"""Requests to answers: keys, providers, recordings and checks of what comes back.

A request is a row with a `state` (JSON) and `questions`, an array of QUESTION; a provider is a function from requests to the same rows
with `answers`, an array of ANSWER in the order of the questions. The engine never needs to know which provider it has.

Kinds: choice picks one of the options; score is the mean index over ordered options; noul is the probability of yes.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable
from urllib import error, request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.failures import materialised
from gristmill.settings.config import Settings

Provider = Callable[[DataFrame], DataFrame]
QUESTION = "struct<id:string,kind:string,instructions:string,options:array<string>,criteria:string>"
ANSWER = "struct<id:string,choice:string,probs:map<string,double>,noul:double,score:double,confidence:double>"
RETRIED = (429, 529)
MAX_RETRIES, FIRST_WAIT, LONGEST_WAIT = 4, 0.5, 16.0
TOLERANCE = 1e-6


def question(id: Column, kind: str, instructions: Column, options: Column, criteria: Column) -> Column:
    """A QUESTION; instructions and criteria are structs, maps or strings, and become JSON."""
    text = lambda c, plain: c if plain else F.to_json(c)
    plain = [isinstance(c, _Text) for c in (instructions, criteria)]
    instructions, criteria = (c.column if isinstance(c, _Text) else c for c in (instructions, criteria))
    return F.struct(id.alias("id"), F.lit(kind).alias("kind"), text(instructions, plain[0]).alias("instructions"), options.cast("array<string>").alias("options"), text(criteria, plain[1]).alias("criteria"))


class _Text:
    def __init__(self, column: Column):
        self.column = column


def as_json(value) -> _Text:
    """A constant of a question, as JSON text."""
    return _Text(F.lit(json.dumps(value, sort_keys=True, ensure_ascii=False)))


def with_key(requests: DataFrame) -> DataFrame:
    """With `request_key`: SHA-256 of state and questions in canonical JSON; equal requests share a key."""
    return requests.withColumn("request_key", F.sha2(F.to_json(F.struct("state", "questions"), {"ignoreNullFields": "false"}), 256))


def replay(stored: DataFrame, missing_fails: bool = True) -> Provider:
    """Answers from stored(request_key, answers), one copy if there are several; a miss fails the job, or stays null with its `error`."""

    def ask(requests: DataFrame) -> DataFrame:
        one = stored.groupBy("request_key").agg(F.first("answers").alias("answers"), F.lit(True).alias("known_"))
        out = with_key(requests).join(one, "request_key", "left")
        lost = F.concat(F.lit("no recording of request "), F.substring("request_key", 1, 12), F.lit(": inputs or tuning differ from the recorded run"))
        if missing_fails:
            out = out.withColumn("answers", F.when(F.col("known_"), F.col("answers")).otherwise(F.raise_error(lost).cast(f"array<{ANSWER}>")))
        else:
            out = out.withColumn("error", F.when(F.col("known_").isNull(), lost))
        return out.drop("known_")

    return ask


def record(answered: DataFrame, path: str) -> None:
    """Appends the answered requests to the recording at path; replay keeps one copy a key."""
    known = answered.where(F.col("answers").isNotNull()).select("request_key", "answers").dropDuplicates(["request_key"])
    known.write.mode("append").parquet(path)


def recording(spark: SparkSession, path: str) -> DataFrame:
    """stored(request_key, answers) of a recording: Parquet, or JSON of {"version": 1, "exchanges": {key: {"answers": {...}}}}.

    A foreign version raises.
    """
    if not path.endswith(".json"):
        return spark.read.parquet(path)
    answer = "map<string,struct<choice:string,probabilities:map<string,double>,noul:double,score:double,confidence:double>>"
    rows = spark.read.schema(f"version int, exchanges map<string,struct<model:string,answers:{answer}>>").json(path, multiLine=True)
    wrong = F.raise_error(F.concat(F.lit("recording version "), F.coalesce(F.col("version").cast("string"), F.lit("none")), F.lit(", want 1"))).cast("map<string,struct<model:string,answers:" + answer + ">>")
    each = rows.select(F.explode(F.when(F.col("version") == 1, F.col("exchanges")).otherwise(wrong)).alias("request_key", "reply"))
    named = F.transform(F.map_entries("reply.answers"), lambda e: F.struct(e["key"].alias("id"), e["value"]["choice"].alias("choice"), e["value"]["probabilities"].alias("probs"), e["value"]["noul"].alias("noul"), e["value"]["score"].alias("score"), e["value"]["confidence"].alias("confidence")))
    return each.select("request_key", named.alias("answers"))


def lexical(requests: DataFrame) -> DataFrame:
    """Deterministic answers for tests and demonstrations.

    An option's weight is 4 to the number of its words, twenty at most, that stand in the state or the instructions; noul is the share of
    the instructions' words that stand in the state. It says nothing about any model's quality.
    """
    plain = lambda s: f"lower(regexp_replace({s}, '\\\\\\\\[nrtbf]', ' '))"  # noqa: E731  JSON's line breaks part words
    words = lambda s: f"filter(split({plain(s)}, '[^\\\\p{{L}}\\\\p{{Nd}}]+'), w -> w <> '')"
    # what the questions may look for in the state is looked up once a request; a question's own words are bound once
    sought = f"concat(flatten(transform(array_distinct(flatten(transform(questions, q -> q.options))), o -> {words('o')})), flatten(transform(filter(questions, q -> q.kind = 'noul'), q -> {words('q.instructions')})))"
    held = f"array_intersect({sought}, {words('coalesce(state, {0})'.format(chr(39) * 2))})"
    weights = f"transform(q.options, o -> power(4D, least(20, size(array_intersect({words('o')}, known)))))"
    share = "coalesce(try_divide(CAST(size(array_intersect(iw, held)) AS DOUBLE), size(array_distinct(iw))), 0D)"
    total = "aggregate(ws, 0D, (a, w) -> a + w)"
    answer = f"""named_struct('id', q.id, 'choice', if(q.kind = 'choice', q.options[array_position(ws, array_max(ws)) - 1], NULL),
        'probs', if(q.kind = 'choice', map_from_arrays(q.options, transform(ws, w -> w / {total})), NULL), 'noul', if(q.kind = 'noul', {share}, NULL),
        'score', if(q.kind = 'score', aggregate(transform(ws, (w, i) -> w * i), 0D, (a, w) -> a + w) / {total}, NULL), 'confidence', if(q.kind = 'choice', array_max(ws) / {total}, NULL))"""
    each = f"transform(array({words('q.instructions')}), iw -> transform(array(concat(held, iw)), known -> transform(array({weights}), ws -> {answer})[0])[0])[0]"
    return with_key(requests).withColumn("answers", F.expr(f"transform(array({held}), held -> transform(questions, q -> {each}))[0]").cast(f"array<{ANSWER}>"))


def wait_before(attempt: int, retry_after: str | None = None, jitter: Callable[[], float] = random.random) -> float:
    """Seconds: half a second doubled for each attempt up to 16, a quarter more by chance; a longer whole-second demand wins."""
    wait = min(LONGEST_WAIT, FIRST_WAIT * 2**attempt) * (1 + 0.25 * jitter())
    asked = int(retry_after) if retry_after and retry_after.strip().isdigit() else 0
    return max(wait, float(asked))


def post(url: str, headers: dict[str, str], body: bytes, timeout: float, retries: int = MAX_RETRIES) -> tuple[dict | None, str | None]:
    """(reply, None) or (None, error) after up to `retries` repeats."""
    for attempt in range(retries + 1):
        try:
            with request.urlopen(request.Request(url, body, {"Content-Type": "application/json", **headers}), timeout=timeout) as reply:
                return json.load(reply), None
        except error.HTTPError as e:
            if attempt == retries or not (e.code in RETRIED or e.code >= 500):
                return None, f"status {e.code}"
            time.sleep(wait_before(attempt, e.headers.get("Retry-After")))
        except (OSError, ValueError) as e:
            return None, type(e).__name__
    return None, "retries used up"


def http(url: str, headers: dict[str, str], concurrency: int, timeout: float = 30.0, retries: int = MAX_RETRIES) -> Provider:
    """One POST a distinct request, at most `concurrency` at a time; errors stay in the row.

    The body is {state, questions: {id: {type, instructions, criteria}}}, the reply {answers: {id: {choice, probabilities, noul, score, confidence}}}.
    """
    one = "map<string,struct<choice:string,probabilities:map<string,double>,noul:double,score:double,confidence:double>>"

    def batches(frames):
        for frame in frames:
            said, errors = [], []
            for state, questions in zip(frame["state"], frame["questions"], strict=True):
                asked = {q["id"]: {"type": q["kind"], "instructions": json.loads(q["instructions"]), "criteria": json.loads(q["criteria"])} for q in json.loads(questions)}
                reply, wrong = post(url, headers, json.dumps({"state": json.loads(state) if state else None, "questions": asked}).encode(), timeout, retries)
                said.append(json.dumps(reply["answers"]) if reply and "answers" in reply else None)
                errors.append(wrong if wrong or said[-1] else "no answers in the reply")
            yield frame[["request_key"]].assign(said=said, error=errors)

    def ask(requests: DataFrame) -> DataFrame:
        keyed = with_key(requests)
        once = keyed.select("request_key", "state", F.to_json("questions").alias("questions")).dropDuplicates(["request_key"]).repartition(concurrency, "request_key")
        replies = once.mapInPandas(batches, "request_key string, said string, error string")
        named = lambda q: F.struct(q["id"].alias("id"), F.try_element_at("by_", q["id"]).alias("a"))
        out = keyed.join(replies, "request_key", "left").withColumn("by_", F.from_json("said", one))
        found = F.transform(F.filter(F.transform("questions", named), lambda x: x["a"].isNotNull()), lambda x: F.struct(x["id"].alias("id"), x["a"]["choice"].alias("choice"), x["a"]["probabilities"].alias("probs"), x["a"]["noul"].alias("noul"), x["a"]["score"].alias("score"), x["a"]["confidence"].alias("confidence")))
        return out.withColumn("answers", found).drop("said", "by_")

    return ask


def provider(spark: SparkSession, settings: Settings) -> Provider:
    """Replay where a recording is named, HTTP with a base URL (recorded where a record is named), else the lexical one."""
    if settings.replay_file:
        return replay(recording(spark, settings.replay_file), missing_fails=False)
    if not settings.base_url:
        return lexical
    live = http(settings.base_url, {"Authorization": f"Bearer {settings.api_key}"}, settings.max_concurrency, settings.timeout, settings.max_retries)
    if not settings.record_file:
        return live

    def ask(requests: DataFrame) -> DataFrame:
        answered = live(requests).persist()  # asked once, though read twice
        record(answered, settings.record_file)
        return answered

    return ask


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), where value is worked out once however often `of` names it; an expression would be worked out each time."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def found(id: Column, ids: Column) -> Column:
    """The first answer of that id, null if there is none. ids: those of the answers, bound once a row."""
    return F.get("answers", F.array_position(ids, id).cast("int") - 1)


def answers(answered: DataFrame, *keys: str) -> DataFrame:
    """(keys..., id, kind, options, answer): a row for each question, its answer null if there is none."""
    each = answered.select(*keys, "answers", F.explode("questions").alias("q"))
    found = F.filter("answers", lambda a: a["id"] == F.col("q.id"))
    return each.select(*keys, F.col("q.id").alias("id"), F.col("q.kind").alias("kind"), F.col("q.options").alias("options"), F.get(found, F.lit(0)).alias("answer"))


def _problem(a: Column, kind: Column, options: Column) -> Column:
    """What is wrong with an answer to a question of this kind and options, null if nothing is."""
    out_of = lambda p, top: p.isNull() | F.isnan(p) | (p < -TOLERANCE) | (p > top + TOLERANCE)
    is_in = lambda p: out_of(p, F.lit(1.0))
    wrong = F.when(a.isNull(), "missing")
    wrong = wrong.when(a["confidence"].isNotNull() & is_in(a["confidence"]), "confidence out of range")
    wrong = wrong.when(F.exists(F.map_values(a["probs"]), is_in), "probability out of range")
    wrong = wrong.when((kind == "noul") & is_in(a["noul"]), "noul missing or out of range")
    wrong = wrong.when((kind == "score") & out_of(a["score"], F.size(options) - 1), "score missing or out of range")
    choice = kind == "choice"
    wrong = wrong.when(choice & a["choice"].isNull(), "no choice").when(choice & (F.coalesce(F.size(a["probs"]), F.lit(0)) <= 0), "empty distribution")
    wrong = wrong.when(choice & ~F.array_contains(options, a["choice"]), "choice is not an option")
    return wrong.when(choice & (F.size(F.array_except(F.map_keys(a["probs"]), options)) > 0), "probability of what is not an option")


def problems(answered: DataFrame) -> DataFrame:
    """(request_key, id, problem): answers that are missing, hold numbers out of range, or name what was not offered."""
    wrong = _problem(F.col("answer"), F.col("kind"), F.col("options"))
    return answers(answered, "request_key").select("request_key", "id", wrong.alias("problem")).where("problem IS NOT NULL")


def asked(provider: Provider, requests: DataFrame, *keep: str, taken: Column | None = None) -> DataFrame:
    """(keep..., answers, failed, wrong), written: a provider's answers, each request asked once.

    failed: the provider's error; wrong: that, or the first answer that `problems` would name. taken: what a stage takes from the answers, written
    as `taken` in their place.
    """
    out = provider(requests)
    failed = F.col("error").cast("string") if "error" in out.columns else F.lit(None).cast("string")
    named = lambda q, ids: F.concat(q["id"], F.lit(": "), bound(found(q["id"], ids), lambda a: _problem(a, q["kind"], q["options"])))
    first = bound(F.transform("answers", lambda a: a["id"]), lambda ids: F.get(F.filter(F.transform("questions", lambda q: named(q, ids)), lambda x: x.isNotNull()), F.lit(0)))
    said = F.col("answers") if taken is None else taken.alias("taken")
    return materialised(out.select(*keep, said, failed.alias("failed"), F.coalesce(failed, first).alias("wrong")))


def p(probs: Column, option) -> Column:
    """The probability of an option; an absent one counts as 0."""
    return F.coalesce(F.try_element_at(probs, option if isinstance(option, Column) else F.lit(option)), F.lit(0.0))


def argmax(probs: Column, options: Column) -> Column:
    """The likeliest of the options, the first on ties; null if none has any mass."""
    top = F.array_max(F.transform(options, lambda o: p(probs, o)))
    return F.when(top > 0, F.get(F.filter(options, lambda o: p(probs, o) == top), F.lit(0)))


def mass(probs: Column, options: Column) -> Column:
    return F.aggregate(F.transform(options, lambda o: p(probs, o)), F.lit(0.0), lambda a, x: a + x)
