"""Question builders: a tuning table's wording around the columns of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.operators.ask import as_json, bound, question
from gristmill.settings.tuning import Tuning

YES_NO = ("true", "false")
KEEP = "specific_requirement"
NONE = "none"


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _with(options: Column, named: dict[str, str], described: Column | None = None) -> tuple[Column, Column]:
    """(options, criteria): the row's options, undescribed unless `described` maps them, then the named ones with their texts.

    An option that a name repeats is offered once.
    """
    every = F.array_distinct(F.concat(options.cast("array<string>"), _strings(named)))
    texts = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])
    if described is None:
        return every, bound(every, lambda os: F.map_from_arrays(os, F.transform(os, lambda o: F.try_element_at(texts, o))))
    # described is bound once: an expression inside a lambda would be worked out again for every option
    of = lambda by: F.map_from_arrays(every, F.transform(every, lambda o: F.coalesce(F.try_element_at(texts, o), F.try_element_at(by, o))))
    return every, F.get(F.transform(F.array(described), of), F.lit(0))


class Prompts:
    def __init__(self, tuning: Tuning):
        ex, ck, h = tuning["extractor"], tuning["checker"], tuning["holistic"]
        self.section, self.summary, self.validation, self.refinement = ex["section"], ex["job_summary"]["system_prompt"], ex["validation"], ex["refinement"]
        self.retrieval, self.gate, self.strength = ck["retrieval"], ck["gate"], ck["strength"]
        self.role_match, self.experience_short, self.blocker = h["role_match"], h["experience_short"], h["blocker"]
        self.importance_levels = ex["refinement"]["importance"]["levels"]
        self.strengths = {k: {"what": o["what"]} | ({"not_for": o["not_for"]} if o.get("not_for") else {}) | ({"examples": o["examples"]} if o.get("examples") else {}) for k, o in self.strength["options"].items()}

    def section_question(self, id: Column, sentence: Column, heading: Column) -> Column:
        """Which section a sentence belongs to; sentence and heading stand in the question."""
        told = F.struct(sentence.alias("sentence"), F.when(F.coalesce(heading, F.lit("")) == "", "(none)").otherwise(heading).alias("heading"), F.lit(self.section["question"]).alias("question"))
        return question(id, "choice", told, _strings(self.section["options"]), as_json(self.section["options"]))

    def validation_question(self, id: Column, chunk: Column, options: Column) -> Column:
        """Which option names the requirement of a chunk, or what else the chunk is."""
        every, criteria = _with(options, self.validation["reject_options"])
        return question(id, "choice", F.struct(chunk.alias("chunk"), F.lit(self.validation["question"]).alias("question")), every, criteria)

    def _about(self, requirement: Column, mentions: Column, text: str) -> Column:
        return F.struct(requirement.alias("requirement"), mentions.alias("mentions"), F.lit(text).alias("question"))

    def filler_question(self, id: Column, requirement: Column, mentions: Column) -> Column:
        named = {KEEP: self.refinement["filler"]["keep"], **self.refinement["filler"]["reasons"]}
        return question(id, "choice", self._about(requirement, mentions, self.refinement["filler"]["question"]), _strings(named), as_json(named))

    def linking_question(self, what: str, id: Column, requirement: Column, mentions: Column, options: Column) -> Column:
        """what: duplicate or alternative."""
        every, criteria = _with(options, self.refinement[what]["reasons"])
        return question(id, "choice", self._about(requirement, mentions, self.refinement[what]["question"]), every, criteria)

    def importance_question(self, id: Column, requirement: Column, mentions: Column) -> Column:
        return question(id, "score", self._about(requirement, mentions, self.refinement["importance"]["question"]), _strings(self.importance_levels), as_json(self.importance_levels))

    def retrieval_question(self, id: Column, options: Column, contexts: Column) -> Column:
        """Which requirement a statement supports. contexts: option to its sentence, null for none."""
        prefix = self.retrieval["context_prefix"]
        every, criteria = _with(options, {NONE: self.retrieval["none"]}, F.transform_values(contexts, lambda _, c: F.concat(F.lit(prefix), c)))
        return question(id, "choice", F.struct(F.lit(self.retrieval["question"]).alias("question")), every, criteria)

    def _pair(self, task: str, requirement: Column, context: Column) -> Column:
        return F.struct(F.lit(task).alias("task"), requirement.alias("requirement"), F.when(context != "", context).alias("job_posting_context"))

    def gate_question(self, id: Column, requirement: Column, context: Column) -> Column:
        return question(id, "noul", self._pair(self.gate["task"], requirement, context), _strings(YES_NO), as_json({"true": self.gate["if_true"], "false": self.gate["if_false"]}))

    def strength_question(self, id: Column, requirement: Column, context: Column) -> Column:
        return question(id, "choice", self._pair(self.strength["task"], requirement, context), _strings(self.strengths), as_json(self.strengths))

    def holistic_questions(self) -> Column:
        """The three questions over a whole pair."""
        role = question(F.lit("role_match"), "score", as_json(self.role_match["question"]), _strings(self.role_match["levels"]), as_json(self.role_match["levels"]))
        yes_no = [question(F.lit(k), "noul", as_json(t["question"]), _strings(YES_NO), as_json({"true": t["if_true"], "false": t["if_false"]})) for k, t in (("blocker", self.blocker), ("experience_short", self.experience_short))]
        return F.array(*yes_no, role)
