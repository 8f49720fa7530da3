"""Text operators as expressions of a dialect. Each takes and returns SQL text."""

from __future__ import annotations

from gristmill.functions import lexicon as X

ALNUM = "[\\p{L}\\p{Nd}]"
OPENERS = "[(\"'“‘\\[{]"
CLOSERS = "[,;:.!?\"')\\]}’”]"
BREAKERS = "[,;:.!?)\\]}]"
MARKER = "^(?:[•·▪◦●‣*-]+|[0-9]{1,3}[.)]|#{1,6})[ \\t\\r\\f]*"


def trim(d, s):
    return d.sub(d.sub(s, "^[\\s\u00a0]+"), "[\\s\u00a0]+$")


def squeeze(d, s):
    """White space to single spaces, none at the ends."""
    return f"trim({d.sub(s, '[ \\t\\r\\n\\f]+', ' ')})"


def posting_text(d, s):
    """What stands under the full-description marker, below the first line; all of it without the marker."""
    mark = "\n### Full Job Description\n"
    below = d.sub(f"substr({s}, instr({s}, {d.lit(mark)}) + {len(mark)})", "^\\n+")
    return f"CASE WHEN instr({s}, {d.lit(mark)}) > 0 THEN concat({d.at(d.split(s, chr(10)), '1')}, {d.lit(chr(10) * 2)}, {below}) ELSE {s} END"


def title(d, s):
    lines = d.map(d.split(s, "\n"), "x", f"trim({d.sub('x', '^[# ]+')})")
    return f"coalesce({d.at(d.keep(lines, 'y', 'y <> ' + d.lit('')), '1')}, '')"


def marker(d, s):
    return d.get(s, MARKER)


def split_line(d, s):
    """Sentences of a line: marks between them, taken back after abbreviations, cut at what is left."""
    mark = "\u0001"
    ended = d.sub(s, "([.!?][)\\]\"'’”]*) ([\\p{Lu}\\p{Nd}(\"'“‘\\[])", f"@1{mark}@2")
    listed = "|".join(a[:-1] for a in X.ABBREVIATIONS)
    closed = "[)\\]\"'’”]*"
    for _ in range(2):  # neighbours share a mark, so every other one each time
        ended = d.sub(ended, f"((?:^|[ {mark}])[(\"'“‘\\[]*(?i:{listed})[.]{closed}){mark}", "@1 ")
        ended = d.sub(ended, f"([^ {mark}]*[.][^ {mark}]*[.]{closed}){mark}", "@1 ")
    return d.keep(d.split(ended, mark), "sl", "sl <> ''")


def is_heading(d, line, mark, parts):
    few = f"({d.size(d.keep(d.split(line, ' '), 'hw', 'hw <> ' + d.lit(''))) } <= 6 AND instr({line}, ',') = 0 AND NOT {d.like(line, '[.!?)]$')})"
    return (
        f"CASE WHEN {parts} <> 1 OR NOT {d.like(line, ALNUM)} THEN false WHEN {d.like(mark, '^#')} THEN true WHEN {mark} <> '' THEN false "
        f"WHEN {d.like(line, ':$')} THEN true ELSE {few} END"
    )


def dashes_apart(d, s):
    return d.sub(s, "([—–])", " @1 ")


def raw_words(d, s):
    return d.keep(d.split(squeeze(d, dashes_apart(d, s)), " "), "rw", "rw <> ''")


def bare(d, w):
    """A word without the punctuation around it."""
    return d.sub(d.sub(w, "^" + OPENERS + "+"), CLOSERS + "+$")


def tail(d, w):
    return d.get(d.sub(w, "^" + OPENERS + "+"), CLOSERS + "+$")


def split_slashes(d, w):
    parts = d.split(w, "/")
    good = d.all(parts, "sp", f"({d.length('sp')} >= 3 AND {d.like('sp', ALNUM)})")
    return f"CASE WHEN {good} THEN {parts} ELSE {d.split(w, chr(3))} END"


def strip_label(d, s):
    word = "[A-Z][\\w&'’/+-]*"
    pattern = f"^({word}(?:[ \\t]+(?:{word}|&|and|of|the|to|for|in)){{1,3}}):[ \\t]+([^ \\t].*)$"
    head = f"substr({s}, 1, instr({s}, ': ') - 1)"
    known = f"instr({s}, ': ') > 1 AND {d.has(d.words(*X.LABELS), f'lower({head})')}"
    return f"CASE WHEN {d.like(s, pattern)} THEN {d.get(s, pattern, 2)} WHEN {known} THEN trim(substr({s}, instr({s}, ': ') + 2)) ELSE {s} END"


def is_stopword(d, w):
    return d.has(d.words(*X.STOPWORDS), f"lower({w})")


def is_generic_only(d, s):
    words = d.keep(d.split(squeeze(d, f"lower({s})"), " "), "gw", "gw <> ''")
    plain = d.all(words, "gx", f"({d.has(d.words(*X.GENERIC, *X.STOPWORDS), 'gx')} OR NOT {d.like('gx', '[\\p{L}]')})")
    return f"(coalesce({d.at(words, '1')}, '') IN ('year', 'years') OR {plain})"


def title_words(d, s):
    return d.keep(d.split(d.sub(f"lower({s})", "[^\\p{L}\\p{Nd}+#.]+", " "), " "), "tw", "tw <> ''")


def is_title_fragment(d, value, of):
    """value, of: arrays of title words."""
    inside = f"instr(concat(' ', {d.join(of, ' ')}, ' '), concat(' ', {d.join(value, ' ')}, ' ')) > 0"
    role = d.any(value, "tr", d.has(d.words(*X.ROLE_WORDS), "tr"))
    return f"({d.size(value)} > 0 AND {d.size(of)} > 0 AND ({value} = {of} OR ({d.size(value)} >= 2 AND {role} AND {inside})))"


def truncate_words(d, s, n):
    cut = f"substr({s}, 1, {n})"
    return f"CASE WHEN {d.length(s)} <= {n} THEN {s} WHEN instr({cut}, ' ') > 0 THEN {d.sub(cut, ' [^ ]*$')} ELSE {cut} END"


def normal(d, s):
    straight = d.sub(d.sub(d.sub(s, "[’‘]", "'"), "[“”]"), "[—–]", " ")
    return f"trim({d.sub(d.sub(f'lower({straight})', '[^a-z0-9+#./\'\\s-]', ' '), '\\s+', ' ')})"


def stem(d, w):
    cases = " ".join(f"WHEN {w} LIKE '%{s}' AND {d.octets(w)} >= {len(s) + 4} THEN substr({w}, 1, {d.length(w)} - {len(s)})" for s in X.SUFFIXES)
    return f"CASE {cases} ELSE {w} END"


def content(d, s):
    """Stems of the words that carry meaning."""
    words = d.map(d.split(d.sub(normal(d, s), "[/-]", " "), " "), "cw", d.sub("cw", "^[.']+|[.']+$"))
    kept = d.keep(words, "cx", f"cx <> '' AND NOT {d.has(d.words(*X.MATCH_STOPWORDS), 'cx')}")
    return d.map(kept, "cy", stem(d, "cy"))


def same_token(d, a, b):
    return f"({a} = {b} OR (least({d.octets(a)}, {d.octets(b)}) >= 5 AND (starts_with({a}, {b}) OR starts_with({b}, {a}))))" if d.name == "duck" else f"({a} = {b} OR (least({d.octets(a)}, {d.octets(b)}) >= 5 AND (startswith({a}, {b}) OR startswith({b}, {a}))))"


def shared(d, a, b):
    """Tokens of a that equal some token of b."""
    return d.size(d.keep(a, "sa", d.any(b, "sb", same_token(d, "sa", "sb"))))


def fuzzy_jaccard(d, a, b):
    n = shared(d, a, b)
    return f"coalesce({d.div(n, f'({d.size(a)} + {d.size(b)} - {n})')}, 0)"


def loose_match(d, v, p):
    """v: content of a variant, p: content of a prediction."""
    nv, np = d.size(v), d.size(p)
    return (
        f"({np} > 0 AND {nv} > 0 AND (({shared(d, v, p)} = {nv} AND {np} - {nv} <= 3) OR ({shared(d, p, v)} = {np} AND {np} >= 2 AND {nv} - {np} <= 1) "
        f"OR {fuzzy_jaccard(d, v, p)} >= 0.6))"
    )


def trigrams(d, s):
    padded = f"concat(' ', {s}, ' ')"
    return d.distinct(d.map(d.seq(f"{d.length(padded)} - 2"), "g", f"substr({padded}, CAST(g AS INT), 3)"))


def set_jaccard(d, a, b):
    both = d.size(d.keep(a, "ja", d.has(b, "ja")))
    return f"coalesce({d.div(both, f'({d.size(a)} + {d.size(b)} - {both})')}, 0)"


def similar(d, a, b, ga, gb):
    """Two values share a telling word or a third of their trigrams."""
    plain = d.words(*X.STOPWORDS, *X.GENERIC)
    said = lambda s: d.split(squeeze(d, f"lower({s})"), " ")
    word = d.any(said(a), "va", f"va <> '' AND NOT {d.has(plain, 'va')} AND {d.has(said(b), 'va')}")
    return f"({word} OR {set_jaccard(d, ga, gb)} >= {X.TRIGRAM_SIMILAR})"


def resume_section(d, h):
    cases = " ".join(f"WHEN {' OR '.join(f'instr(lower({h}), {d.lit(w)}) > 0' for w in words)} THEN '{name}'" for name, words in X.RESUME_SECTIONS)
    return f"CASE {cases} ELSE 'other' END"


def redact(d, s):
    return d.sub(s, X.SECRET_LIKE, "[redacted]")


def judge_normal(d, s):
    return f"lower({squeeze(d, d.sub(s, '[*_`#•·–—-]+', ' '))})"
