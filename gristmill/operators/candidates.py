"""Postings to sentences, tokens, chunks and options inside the row: one scan, no shuffle.

Each function takes a DataFrame and adds an array column, or explodes one; every step is a higher-order function over the
arrays of one row, linear in its length. A row is a posting, a sentence or a chunk, so rows stay small at every scale.

Rows are exploded by outer generators and filtered above them: a filter on an array would be pushed below the projections
that build it, with all of their expressions written out in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import lexicon as X
from gristmill.functions import text as T
from gristmill.functions.dialect import SPARK as D

SENTENCE = "array<struct<ord:bigint,ref:string,text:string,heading:string,strong:boolean>>"


#: The first and last characters of words that may have punctuation around them; a pattern's end also lies before a last line end.
_OPENING, _CLOSING = "(\"'“‘[{", ",;:.!?\"')]}’”\n\r\u0085\u2028\u2029"


def _among(expression: str, words: tuple[str, ...]) -> str:
    return f"{expression} IN ({', '.join(D.lit(w) for w in words)})"


def exploded(rows: DataFrame, array: str, pos: str, value: str) -> DataFrame:
    """rows without the array, with a row for each element; positions from 0."""
    rest = [c for c in rows.columns if c != array]
    return rows.select(*rest, F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())


def not_empty(rows: DataFrame, array: str) -> DataFrame:
    """rows whose array has elements."""
    rest = [c for c in rows.columns if c != array]
    return rows.select(*rest, F.explode_outer(F.expr(f"filter(array({array}), a -> size(a) > 0)")).alias(array)).where(F.col(array).isNotNull())


def with_sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `sentences`: ord, ref, text, nearest heading, and whether the line is a strong heading."""
    lines = docs.withColumn("ws_lines", F.expr(f"transform(split(coalesce({text}, ''), '\\n'), l -> {T.trim(D, 'l')})"))
    lines = lines.withColumn("ws_lines", F.expr(f"transform(ws_lines, l -> named_struct('mk', {T.marker(D, 'l')}, 'line', l))"))
    body = T.squeeze(D, "substr(l.line, length(l.mk) + 1)")
    lines = lines.withColumn("ws_lines", F.expr(f"transform(ws_lines, l -> named_struct('mk', l.mk, 'body', {body}))"))
    lines = lines.withColumn("ws_lines", F.expr(f"transform(ws_lines, l -> named_struct('mk', l.mk, 'body', l.body, 'parts', {T.split_line(D, 'l.body')}))"))
    lines = lines.withColumn("ws_lines", F.expr(f"transform(ws_lines, l -> named_struct('mk', l.mk, 'body', l.body, 'parts', l.parts, 'head', {T.is_heading(D, 'l.body', 'l.mk', 'size(l.parts)')}))"))
    # the lines from each heading to the next share it
    lines = lines.withColumn("ws_from", F.expr("concat(array(-1), filter(transform(ws_lines, (l, i) -> if(l.head, i, -1)), i -> i >= 0))"))
    run = "slice(ws_lines, greatest(x, 0) + 1, coalesce(get(ws_from, k + 1), size(ws_lines)) - greatest(x, 0))"
    strong = f"l.head AND (startswith(l.mk, '#') OR endswith(l.body, ':'))"
    said = f"flatten(transform(ws_from, (x, k) -> flatten(transform({run}, l -> transform(l.parts, p -> named_struct('text', p, 'heading', if(x < 0, '', ws_lines[greatest(x, 0)].body), 'strong', {strong}))))))"
    said = f"filter({said}, s -> {D.like('s.text', T.ALNUM)})"
    out = lines.withColumn("ws_said", F.expr(said))
    number = "transform(ws_said, (s, i) -> named_struct('ord', CAST(i + 1 AS BIGINT), 'ref', concat('s', CAST(i + 1 AS STRING)), 'text', s.text, 'heading', s.heading, 'strong', s.strong))"
    return out.withColumn("sentences", F.expr(number)).drop("ws_lines", "ws_from", "ws_said")


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, ref, text, heading, strong)."""
    return exploded(with_sentences(docs.select(key, text), text).select(key, "sentences"), "sentences", "n_", "s_").select(key, "s_.*")


def with_tokens(rows: DataFrame, slashes: bool, text: str = "text", to: str = "toks") -> DataFrame:
    """rows with an array of tokens (text, brk, stop): words without punctuation; brk: a clause ends after the token."""
    out = rows.withColumn("wt_raw", F.expr(T.raw_words(D, f"coalesce({text}, '')")))
    # patterns are tried only on words with such a mark at an end
    opening = f"instr({D.lit(_OPENING)}, substr(w, 1, 1)) > 0"
    out = out.withColumn("wt_raw", F.expr(f"transform(wt_raw, w -> named_struct('w', w, 'open', {opening}, 'edge', {opening} OR instr({D.lit(_CLOSING)}, substr(w, -1, 1)) > 0))"))
    out = out.withColumn("wt_raw", F.expr(f"transform(wt_raw, x -> named_struct('w', x.w, 'open', x.open, 'text', if(x.edge, {T.bare(D, 'x.w')}, x.w), 'after', if(x.edge, {T.tail(D, 'x.w')}, '')))"))
    word, opens = D.like("x.text", T.ALNUM), D.like("x.w", "^" + T.OPENERS + "*[(\\[{]")
    out = out.withColumn("wt_raw", F.expr(f"transform(wt_raw, x -> named_struct('text', x.text, 'ends', x.after <> '' AND {D.like('x.after', T.BREAKERS)}, 'word', {word}, 'opens', x.open AND {opens}))"))
    # what stands next, a mark or a word, says whether it opens a clause
    plain = "transform(wt_raw, (x, i) -> named_struct('text', x.text, 'brk', x.ends OR coalesce(NOT get(wt_raw, i + 1).word OR get(wt_raw, i + 1).opens, false), 'word', x.word))"
    out = out.withColumn("wt_toks", F.expr(f"filter({plain}, x -> x.word)"))
    if slashes:
        parts = f"if(instr(x.text, '/') = 0 AND instr(x.text, {D.lit(chr(3))}) = 0, array(x.text), {T.split_slashes(D, 'x.text')})"
        out = out.withColumn("wt_toks", F.expr(f"flatten(transform(transform(wt_toks, x -> named_struct('parts', {parts}, 'brk', x.brk)), x -> transform(x.parts, (p, k) -> named_struct('text', p, 'brk', x.brk OR k < size(x.parts) - 1))))"))
    stop = _among("lower(x.text)", X.STOPWORDS)
    return out.withColumn(to, F.expr(f"transform(wt_toks, x -> named_struct('text', x.text, 'brk', x.brk, 'stop', {stop}))")).drop("wt_raw", "wt_toks")


def tokens(rows: DataFrame, slashes: bool, text: str = "text") -> DataFrame:
    """The columns of rows but `text`, with tok, text and break_after: a row for each token."""
    rest = [c for c in rows.columns if c != text]
    out = exploded(with_tokens(rows, slashes, text).select(*rest, "toks"), "toks", "tok", "t")
    return out.select(*rest, (F.col("tok") + 1).cast("long").alias("tok"), F.col("t.text").alias("text"), F.col("t.brk").alias("break_after"))


def with_chunks(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with `chunks`: texts of the pieces between clause ends and separator words; "such" and "as" part only together."""
    out = with_tokens(rows, False, text, "wc_toks")
    sep = f"({_among('lower(x.text)', X.SEPARATORS)} AND (lower(x.text) <> 'such' OR coalesce(lower(get(wc_toks, i + 1).text), '') = 'as')) OR (lower(x.text) = 'as' AND coalesce(lower(get(wc_toks, i - 1).text), '') = 'such')"
    out = out.withColumn("wc_toks", F.expr(f"transform(wc_toks, (x, i) -> named_struct('text', x.text, 'brk', x.brk, 'sep', {sep}))"))
    starts = "filter(transform(wc_toks, (x, i) -> if(NOT x.sep AND (i = 0 OR get(wc_toks, i - 1).sep OR get(wc_toks, i - 1).brk), i, -1)), i -> i >= 0)"
    out = out.withColumn("wc_from", F.expr(starts))
    piece = "filter(slice(wc_toks, s + 1, coalesce(get(wc_from, k + 1), size(wc_toks)) - s), x -> NOT x.sep)"
    return out.withColumn("chunks", F.expr(f"transform(wc_from, (s, k) -> array_join(transform({piece}, x -> x.text), ' '))")).drop("wc_toks", "wc_from")


def chunks(rows: DataFrame, text: str = "text") -> DataFrame:
    """The columns of rows but `text`, with chunk_no and the chunk's text."""
    rest = [c for c in rows.columns if c != text]
    out = exploded(with_chunks(rows, text).select(*rest, "chunks"), "chunks", "chunk_no", "text")
    return out.withColumn("chunk_no", (F.col("chunk_no") + 1).cast("long"))


def _windows(toks: str, longest: int) -> str:
    """Runs of up to `longest` tokens inside a clause, with a letter and no stop word at either edge: (start, n, text)."""
    run = f"transform(sequence(1, least({longest}, size({toks}) - i)), n -> named_struct('start', CAST(i + 1 AS BIGINT), 'n', CAST(n AS BIGINT), 'ts', slice({toks}, i + 1, n)))"
    good = "NOT w.ts[0].stop AND NOT element_at(w.ts, -1).stop AND NOT exists(slice(w.ts, 1, size(w.ts) - 1), x -> x.brk)"
    named = "named_struct('start', w.start, 'n', w.n, 'text', array_join(transform(w.ts, x -> x.text), ' '))"
    every = f"flatten(transform(if(size({toks}) > 0, sequence(0, size({toks}) - 1), CAST(array() AS ARRAY<INT>)), i -> transform(filter({run}, w -> {good}), w -> {named})))"
    return f"filter({every}, w -> {D.like('w.text', '[\\p{L}]')})"


def with_windows(rows: DataFrame, slashes: bool, text: str = "text", longest: int = X.MAX_WINDOW) -> DataFrame:
    """rows with `windows` (start, n, text) of one tokenization, by start and length."""
    return with_tokens(rows, slashes, text, "wi_toks").withColumn("windows", F.expr(_windows("wi_toks", longest))).drop("wi_toks")


def windows(rows: DataFrame, slashes: bool, text: str = "text", longest: int = X.MAX_WINDOW) -> DataFrame:
    """The columns of rows but `text`, with start, n and text: a row for each window of one tokenization."""
    rest = [c for c in rows.columns if c != text]
    return exploded(with_windows(rows, slashes, text, longest).select(*rest, "windows"), "windows", "n_", "w_").select(*rest, "w_.*")


def _generic(s: str) -> str:
    words = f"filter(split({T.squeeze(D, f'lower({s})')}, ' '), w -> w <> '')"
    plain = f"forall(ws, w -> {_among('w', (*X.GENERIC, *X.STOPWORDS))} OR NOT {D.like('w', '[\\p{L}]')})"
    return f"get(transform(array({words}), ws -> coalesce(get(ws, 0), '') IN ('year', 'years') OR {plain}), 0)"


def _marked(toks: str) -> str:
    """Tokens with what an option asks of them: whether one may begin (no stop word, no year), whether it tells anything, what stands at its end."""
    first = f"NOT x.stop AND NOT {_among('lower(x.text)', ('year', 'years'))}"
    tells = f"NOT {_among('lower(x.text)', (*X.GENERIC, *X.STOPWORDS))} AND {D.like('x.text', '[\\p{L}]')}"
    return f"transform({toks}, x -> named_struct('text', x.text, 'brk', x.brk, 'stop', x.stop, 'first', {first}, 'tells', {tells}))"


def _telling_windows(toks: str, longest: int) -> str:
    """The texts of `_windows` that are not generic, in the same order, from `_marked` tokens: no window is built but those that stand.

    A token has no white space, so a window's words are its tokens; one that tells something has a letter.
    """
    at = [f"get({toks}, i + {k})" if k else "x" for k in range(longest)]
    whole = lambda k: f"concat_ws(' ', {', '.join(f'{t}.text' for t in at[: k + 1])})"
    stands = lambda k: " AND ".join([*(f"NOT {t}.brk" for t in at[:k]), f"NOT {at[k]}.stop", f"({' OR '.join(f'{t}.tells' for t in at[: k + 1])})"])
    each = ", ".join(f"if({stands(k)}, {whole(k)}, NULL)" for k in range(longest))
    return f"filter(flatten(transform({toks}, (x, i) -> if(x.first, array({each}), CAST(array() AS ARRAY<STRING>)))), w -> w IS NOT NULL)"


def with_options(rows: DataFrame, text: str = "text", longest: int = X.MAX_WINDOW) -> DataFrame:
    """rows, a chunk each, with `options`: the whole chunk if short, then its windows over both tokenizations.

    Unique by lower case, the first spelling wins; none that is generic only; MAX_OPTIONS at most.
    """
    # where nothing is split, by a slash or by the sign that stands for none, both tokenizations are one, and the second adds nothing
    second = f"if(instr({text}, '/') > 0 OR instr({text}, {D.lit(chr(3))}) > 0, {text}, '')"
    out = with_tokens(with_tokens(rows, True, text, "wo_a"), False, second, "wo_b").withColumn("wo_words", F.split(text, " "))
    edge = lambda w: _among(f"lower({w})", X.STOPWORDS)
    short = f"size(wo_words) <= {X.MAX_CHUNK_WORDS} AND NOT {edge('wo_words[0]')} AND NOT {edge('element_at(wo_words, -1)')} AND {D.like(text, '[\\p{L}]')}"
    out = out.withColumn("wo_a", F.expr(_marked("wo_a"))).withColumn("wo_b", F.expr(_marked("wo_b")))
    out = out.withColumn("wo_all", F.expr(f"concat(if({short} AND NOT {_generic(text)}, array({text}), CAST(array() AS ARRAY<STRING>)), {_telling_windows('wo_a', longest)}, {_telling_windows('wo_b', longest)})"))
    out = out.withColumn("wo_low", F.expr("transform(wo_all, o -> lower(o))")).withColumn("wo_one", F.expr("array_distinct(wo_low)"))
    # each spelling in lower case, in order of its first place, where the first spelling stands
    again = f"transform(slice(wo_one, 1, {X.MAX_OPTIONS}), l -> get(wo_all, CAST(array_position(wo_low, l) AS INT) - 1))"
    unique = f"if(size(wo_one) = size(wo_low), slice(wo_all, 1, {X.MAX_OPTIONS}), {again})"
    return out.withColumn("options", F.expr(unique)).drop("wo_a", "wo_b", "wo_words", "wo_all", "wo_low", "wo_one")


def options(rows: DataFrame, text: str = "text") -> DataFrame:
    """The columns of rows but `text`, with chunk_no, opt_ord and option, over the chunks of each sentence."""
    rest = [c for c in rows.columns if c != text]
    out = exploded(with_options(chunks(rows, text)).select(*rest, "chunk_no", "options"), "options", "opt_ord", "option")
    return out.withColumn("opt_ord", (F.col("opt_ord") + 1).cast("long"))
