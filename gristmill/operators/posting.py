"""Postings to sentences, tokens, chunks and options. Each function gives SQL text over a relation (doc_id, text)."""

from __future__ import annotations

from gristmill.functions import lexicon as X
from gristmill.functions import text as T


def lines(d, source: str) -> str:
    """(doc_id, line_no, line): trimmed lines."""
    rows = d.explode(source, "doc_id", d.split("text", "\n"), "line_no", "raw")
    return f"(SELECT doc_id, line_no, {T.trim(d, 'raw')} AS line FROM {rows} r_)"


def headed_lines(d, source: str) -> str:
    """(doc_id, line_no, mk, body, parts, heading, strong, current): lines with their marker, sentences and heading."""
    a = f"(SELECT doc_id, line_no, line, {T.marker(d, 'line')} AS mk FROM {lines(d, source)} l_)"
    b = f"(SELECT doc_id, line_no, mk, {T.squeeze(d, 'substr(line, length(mk) + 1)')} AS body FROM {a} a_)"
    c = f"(SELECT doc_id, line_no, mk, body, {T.split_line(d, 'body')} AS parts FROM {b} b_)"
    e = f"(SELECT *, {T.is_heading(d, 'body', 'mk', d.size('parts'))} AS heading FROM {c} c_)"
    over = "PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return (
        f"(SELECT doc_id, line_no, mk, body, parts, heading, heading AND ({d.like('mk', '^#')} OR {d.like('body', ':$')}) AS strong, "
        f"coalesce({d.last('CASE WHEN heading THEN body END', over)}, '') AS current_heading FROM {e} e_)"
    )


def sentences(d, source: str) -> str:
    """(doc_id, ord, ref, text, heading, strong): sentences with a letter or digit, under their heading."""
    rows = d.explode(headed_lines(d, source) + " h_", "doc_id, line_no, current_heading, strong", "parts", "part_no", "part")
    numbered = f"(SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part_no) AS BIGINT) AS ord FROM {rows} p_ WHERE {d.like('part', T.ALNUM)})"
    return f"(SELECT doc_id, ord, concat('s', CAST(ord AS STRING)) AS ref, part AS text, current_heading AS heading, strong FROM {numbered} n_)"


def tokens(d, source: str, key: str, slashes: bool) -> str:
    """(key..., tok, text, break_after): words without their punctuation; key: the columns of a sentence, `text` its text."""
    words = d.explode(source, key, T.raw_words(d, "text"), "pos", "w")
    a = f"(SELECT {key}, pos, {T.bare(d, 'w')} AS word, {T.tail(d, 'w')} AS after, {d.like('w', '^' + T.OPENERS + '*[(\\[{]')} AS opens FROM {words} w_)"
    b = f"(SELECT *, {d.like('word', T.ALNUM)} AS is_word FROM {a} a_)"
    c = f"(SELECT *, sum(CASE WHEN is_word THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS tok_no FROM {b} b_)"
    e = f"(SELECT *, max(CASE WHEN is_word THEN 0 ELSE 1 END) OVER (PARTITION BY {key}, tok_no) AS mark FROM {c} c_)"
    f = (
        f"(SELECT {key}, tok_no, word, ({d.like('after', T.BREAKERS)} OR mark = 1 OR coalesce(lead(opens) OVER (PARTITION BY {key} ORDER BY pos), false)) AS ends "
        f"FROM {e} e_ WHERE is_word)"
    )
    if not slashes:
        return f"(SELECT {key}, CAST(tok_no AS BIGINT) AS tok, word AS text, ends AS break_after FROM {f} f_)"
    g = f"(SELECT {key}, tok_no, ends, {T.split_slashes(d, 'word')} AS parts FROM {f} f_)"
    h = d.explode(g + " g_", f"{key}, tok_no, ends, {d.size('parts')} AS n_parts", "parts", "part_no", "part")
    return (
        f"(SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY tok_no, part_no) AS BIGINT) AS tok, part AS text, "
        f"CASE WHEN part_no < n_parts - 1 THEN true ELSE ends END AS break_after FROM {h} h_)"
    )


def chunks(d, source: str, key: str) -> str:
    """(key..., chunk_no, text): clause-sized pieces between breaks and separator words."""
    over = f"(PARTITION BY {key} ORDER BY tok)"
    a = f"(SELECT *, lower(text) AS w, lead(lower(text)) OVER {over} AS next_w, lag(lower(text)) OVER {over} AS prev_w FROM {tokens(d, source, key, False)} t_)"
    b = f"(SELECT *, (({d.has(d.words(*X.SEPARATORS), 'w')} AND (w <> 'such' OR coalesce(next_w, '') = 'as')) OR (w = 'as' AND coalesce(prev_w, '') = 'such')) AS sep FROM {a} a_)"
    c = f"(SELECT *, CASE WHEN sep OR coalesce(lag(break_after AND NOT sep) OVER {over}, false) THEN 1 ELSE 0 END AS bump FROM {b} b_)"
    e = f"(SELECT *, sum(bump) OVER (PARTITION BY {key} ORDER BY tok ROWS UNBOUNDED PRECEDING) AS piece FROM {c} c_)"
    f = f"(SELECT {key}, piece, {d.ordered('text', 'tok', ' ')} AS text FROM {e} e_ WHERE NOT sep GROUP BY {key}, piece)"
    return f"(SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY piece) AS BIGINT) AS chunk_no, text FROM {f} f_)"


def _edges(d, first: str, last: str) -> str:
    return f"NOT {T.is_stopword(d, first)} AND NOT {T.is_stopword(d, last)}"


def windows(d, source: str, key: str, slashes: bool, longest: int = X.MAX_WINDOW) -> str:
    """(key..., start, n, text): runs of up to `longest` tokens inside one clause, without stop words at the edges."""
    over = f"PARTITION BY {key} ORDER BY tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    a = f"(SELECT *, coalesce(sum(CASE WHEN break_after THEN 1 ELSE 0 END) OVER ({over}), 0) AS clause FROM {tokens(d, source, key, slashes)} t_)"
    frame = f"PARTITION BY {key}, clause ORDER BY tok"
    more = ", ".join(f"lead(text, {k}) OVER ({frame}) AS t{k}" for k in range(1, longest))
    b = f"(SELECT *, text AS t0, {more} FROM {a} a_)"
    parts = [f"SELECT {key}, tok AS start, CAST({k + 1} AS BIGINT) AS n, t0, t{k} AS t_last, concat_ws(' ', {', '.join(f't{j}' for j in range(k + 1))}) AS text FROM {b} b{k}_ WHERE t{k} IS NOT NULL" for k in range(longest)]
    return f"(SELECT {key}, start, n, text FROM ({' UNION ALL '.join(parts)}) u_ WHERE {_edges(d, 't0', 't_last')} AND {d.like('text', '[\\p{L}]')})"


def options(d, source: str, key: str) -> str:
    """(key..., chunk_no, opt_ord, option): the whole chunk if short, then its windows, unique, not generic, 250 at most."""
    ck = f"{key}, chunk_no"
    c = chunks(d, source, key)
    words = d.split("text", " ")
    whole = (
        f"SELECT {ck}, CAST(0 AS BIGINT) AS src, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS n, text FROM {c} c0_ WHERE {d.size(words)} <= {X.MAX_CHUNK_WORDS} "
        f"AND {_edges(d, d.at(words, '1'), d.at(words, d.size(words)))} AND {d.like('text', '[\\p{L}]')}"
    )
    rest = [f"SELECT {ck}, CAST({i} AS BIGINT) AS src, start, n, text FROM {windows(d, c + f' c{i}_', ck, s)} w{i}_" for i, s in ((1, True), (2, False))]
    a = f"(SELECT * FROM ({' UNION ALL '.join([whole, *rest])}) u_ WHERE NOT {T.is_generic_only(d, 'text')})"
    b = f"(SELECT *, row_number() OVER (PARTITION BY {ck}, lower(text) ORDER BY src, start, n) AS seen FROM {a} a_)"
    e = f"(SELECT {ck}, text AS option, CAST(row_number() OVER (PARTITION BY {ck} ORDER BY src, start, n) AS BIGINT) AS opt_ord FROM {b} b_ WHERE seen = 1)"
    return f"(SELECT {ck}, opt_ord, option FROM {e} e_ WHERE opt_ord <= {X.MAX_OPTIONS})"
