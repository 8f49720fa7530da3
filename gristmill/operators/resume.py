"""Resumes to evidence units: gaps and islands over lines. SQL text over a relation (doc_id, text)."""

from __future__ import annotations

from gristmill.functions import lexicon as X
from gristmill.functions import text as T


def skills_chunks(d, source: str, key: str, line: str) -> str:
    """(key..., part, piece): a skills line in balanced chunks of six items at most, each with the line's label.

    source: (key..., line), one line a key. Items part at commas outside brackets: running sums over the pieces between
    commas tell which commas those are. A short line is one piece, unchanged.
    """
    a = f"(SELECT {key}, {line} AS k_line, substr({line}, 1, greatest(instr({line}, ':') - 1, 0)) AS k_head FROM {source})"
    words = d.size(d.keep(d.split(T.squeeze(d, "k_head"), " "), "lw", "lw <> ''"))
    b = f"(SELECT {key}, k_line, k_head, (k_head <> '' AND instr(k_head, ',') = 0 AND {words} <= 4) AS k_labelled FROM {a} ka_)"
    label, rest = "CASE WHEN k_labelled THEN concat(k_head, ': ') ELSE '' END", "CASE WHEN k_labelled THEN substr(k_line, instr(k_line, ':') + 1) ELSE k_line END"
    depth = f"({d.length(d.sub('k_piece', '[)\\]]'))} - {d.length(d.sub('k_piece', '[(\\[]'))})"
    if d.name == "spark":
        return _chunks_in_row(d, f"(SELECT {key}, k_line, {label} AS k_label, {d.split(rest, ',')} AS k_ps FROM {b} kb_)", key, depth)
    c = d.explode(f"{b} kb_", f"{key}, k_line, {label} AS k_label", d.split(rest, ","), "k_pos", "k_piece")
    frame = f"PARTITION BY {key} ORDER BY k_pos ROWS"
    e = f"(SELECT *, sum({depth}) OVER ({frame} UNBOUNDED PRECEDING) AS k_open FROM {c} kc_)"
    f = f"(SELECT *, k_open - least(0, min(k_open) OVER ({frame} UNBOUNDED PRECEDING)) AS k_level FROM {e} ke_)"
    g = f"(SELECT *, CASE WHEN coalesce(lag(k_level) OVER (PARTITION BY {key} ORDER BY k_pos), 0) = 0 THEN 1 ELSE 0 END AS k_new FROM {f} kf_)"
    h = f"(SELECT *, sum(k_new) OVER ({frame} UNBOUNDED PRECEDING) - 1 AS k_item FROM {g} kg_)"
    i = f"(SELECT {key}, min(k_line) AS k_line, min(k_label) AS k_label, k_item, trim({d.ordered('k_piece', 'k_pos', ',')}) AS k_text FROM {h} kh_ GROUP BY {key}, k_item)"
    j = f"(SELECT *, CAST(count(*) OVER (PARTITION BY {key}) AS BIGINT) AS k_n FROM {i} ki_)"
    n = str(X.SKILL_ITEMS)
    part = d.idiv(f"k_item * {d.idiv(f'k_n + {X.SKILL_ITEMS - 1}', n)}", "k_n")
    k = f"(SELECT *, CASE WHEN k_n <= {n} THEN CAST(0 AS BIGINT) ELSE {part} END AS part FROM {j} kj_)"
    joined = d.ordered("k_text", "k_item", ", ")
    return f"(SELECT {key}, part, CASE WHEN min(k_n) <= {n} THEN min(k_line) ELSE concat(min(k_label), {joined}) END AS piece FROM {k} kk_ GROUP BY {key}, part)"


def _chunks_in_row(d, source: str, key: str, depth: str) -> str:
    """The same inside the row of a line, for Spark: nothing is shuffled. source: (key..., k_line, k_label, k_ps), k_ps the pieces between commas."""
    n = X.SKILL_ITEMS
    # '1' for each piece after which no bracket is open; closing ones that nothing opened count for nothing
    flags = f"aggregate(k_ps, named_struct('l', CAST(0 AS BIGINT), 's', ''), (s, k_piece) -> named_struct('l', greatest(CAST(0 AS BIGINT), s.l + {depth}), 's', concat(s.s, if(s.l + {depth} <= 0, '1', '0')))).s"
    starts = f"transform(array(split({flags}, '')), fs -> filter(sequence(0, size(k_ps) - 1), p -> p = 0 OR get(fs, p - 1) = '1'))[0]"
    a = f"(SELECT *, {starts} AS k_from FROM {source} kr_)"
    items = "transform(k_from, (x, k) -> trim(array_join(slice(k_ps, x + 1, coalesce(get(k_from, k + 1), size(k_ps)) - x), ',')))"
    b = f"(SELECT {key}, k_line, k_label, {items} AS k_items FROM {a} ks_)"
    parts = f"((size(k_items) + {n - 1}) div {n})"
    at = lambda p: f"CAST(({p} * size(k_items) + {parts} - 1) div {parts} AS INT)"
    chunks = f"transform(sequence(CAST(0 AS BIGINT), {parts} - 1), p -> concat(k_label, array_join(slice(k_items, {at('p')} + 1, {at('(p + 1)')} - {at('p')}), ', ')))"
    c = f"(SELECT {key}, if(size(k_items) <= {n}, array(k_line), {chunks}) AS k_chunks FROM {b} kt_)"
    # an outer generator, filtered above: an inner one's filter would be pushed below the projections, with all of their expressions written out
    e = f"(SELECT {key}, CAST(k_part AS BIGINT) AS part, piece FROM {c} ku_ LATERAL VIEW OUTER posexplode(k_chunks) AS k_part, piece)"
    return f"(SELECT * FROM {e} kv_ WHERE part IS NOT NULL)"


def units(d, source: str) -> str:
    """(doc_id, ord, id, text, section, role, company, dates)."""
    told = f"(SELECT doc_id, text, {d.like('text', '(?m)^\\s*#\\s')} AS marked FROM {source}) m_"
    rows = d.explode(told, "doc_id, marked", d.split("text", "\n"), "line_no", "raw")
    a = f"(SELECT doc_id, line_no, {T.trim(d, 'raw')} AS line, marked FROM {rows} r_)"
    kind = f"CASE WHEN {d.like('line', '^#\\s+')} THEN 'section' WHEN line = '' THEN 'blank' WHEN {d.like('line', '^#{2,6}\\s+')} THEN 'entry' WHEN {d.like('line', '^[-*•·▪◦●‣]\\s+')} THEN 'bullet' ELSE 'text' END"
    b = f"(SELECT *, {kind} AS kind FROM {a} a_)"
    frame = "PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING"
    c = f"(SELECT *, sum(CASE WHEN kind = 'section' THEN 1 ELSE 0 END) OVER ({frame}) AS sec FROM {b} b_)"
    inside = "PARTITION BY doc_id, sec ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    heading = d.last(f"CASE WHEN kind = 'section' THEN {d.sub('line', '^#\\s+')} END", inside)
    entry = d.last(f"CASE WHEN kind = 'entry' THEN {d.sub('line', '^#{2,6}\\s+')} END", inside)
    e = f"(SELECT *, {heading} AS head, {entry} AS entry FROM {c} c_ WHERE sec > 0 OR NOT marked)"
    f = f"(SELECT *, CASE WHEN head IS NULL THEN 'other' ELSE {T.resume_section(d, 'head')} END AS section, {d.map(d.split("coalesce(entry, '')", '|'), 'ep', 'trim(ep)')} AS bits FROM {e} e_)"
    g = f"(SELECT *, sum(CASE WHEN kind <> 'text' OR section = 'skills' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block FROM {f} f_)"
    meta = f"coalesce({d.at('bits', '1')}, '') AS role, coalesce({d.at('bits', '2')}, '') AS company, coalesce({d.at('bits', '3')}, '') AS dates"
    text = f"CASE WHEN kind = 'bullet' THEN {d.sub('line', '^[-*•·▪◦●‣]\\s+')} ELSE line END"
    named = f"concat_ws(', ', nullif({d.at('bits', '1')}, ''), nullif({d.at('bits', '2')}, ''))"
    body = (
        f"(SELECT doc_id, block, min(line_no) AS line_no, min(section) AS section, max(CASE WHEN kind = 'bullet' THEN 1 ELSE 0 END) AS bulleted, min(role) AS role, min(company) AS company, min(dates) AS dates, "
        f"{d.ordered('said', 'line_no', ' ')} AS said FROM (SELECT *, {meta}, {text} AS said FROM {g} g0_ WHERE kind IN ('bullet', 'text')) g1_ GROUP BY doc_id, block)"
    )
    keys = "doc_id, line_no, section, role, company, dates"
    skills = skills_chunks(d, f"{body} b0_ WHERE section = 'skills'", keys, "said")
    rest = f"(SELECT {keys}, CASE WHEN bulleted = 1 THEN {d.split('said', chr(3))} ELSE {T.split_line(d, 'said')} END AS pieces FROM {body} b1_ WHERE section <> 'skills') b2_"
    said = f"(SELECT {keys}, part, piece FROM {skills} b3_ UNION ALL SELECT {keys}, part, piece FROM {d.explode(rest, keys, 'pieces', 'part', 'piece')} b4_)"
    titled = f"SELECT doc_id, line_no, section, {meta}, CAST(0 AS BIGINT) AS part, {named} AS piece FROM {g} g2_ WHERE kind = 'entry' AND section IN ('education', 'certifications')"
    h = f"(SELECT doc_id, line_no, part, section, role, company, dates, {T.squeeze(d, 'piece')} AS text FROM (SELECT doc_id, line_no, section, role, company, dates, part, piece FROM {said} s_ UNION ALL {titled}) u_)"
    i = f"(SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part) AS BIGINT) AS ord FROM {h} h_ WHERE {d.like('text', T.ALNUM)})"
    return f"(SELECT doc_id, ord, concat('e', CAST(ord AS STRING)) AS id, text, section, role, company, dates FROM {i} i_)"
