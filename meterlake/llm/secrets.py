"""Secret scan with DataFrame operations only: fixed patterns, and entropy in a sliding window.

*Patterns.* Each kind's matches are leftmost and don't overlap. Their places follow from the lengths of the matches and
of the gaps between them (``regexp_extract_all`` and ``split`` by the same pattern), as Spark has no function for all
places of a pattern.

*Entropy.* Candidates are runs of 20 or more letters, digits and ``+/_=-``. By its characters a run is of class decimal, hex,
lower (lower-case letters and digits), upper, letters (of both cases) or mixed. A window of 20 characters slides over it;
counts per character and the sum of ``c * log2(c)`` are updated with the character that comes in and the one that leaves,
so a window costs the same whatever its length. Windows whose entropy reaches the class's bound are joined into spans. The
allow-list works in two places: runs of a harmless shape (decimal numbers, UUIDs, words joined by dashes, slashes or
underscores, words in capitals or in camel case) aren't looked at, and spans of up to ``PLACEHOLDER`` characters that hold a
placeholder's word are dropped. Spans that lie within a match of a pattern aren't repeated.

Long texts and runs: whatever is accumulated over the matches or windows of a text is accumulated in blocks of ``BLOCK``, as
an array can only grow by being copied: a text with a million matches costs a few seconds, not hours. The patterns have no
repeated groups but possessive ones, which Java walks through without recursion.

Defined results: null text counts as empty and has no spans; every row gives a row, also one without an id and repeated
ones; of equal starts the kinds come in their order; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in their order, with pattern and least length (of group 2 for assign).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
BOUNDS = {"hex": 2.9, "lower": 3.4, "upper": 3.4, "letters": 3.8, "mixed": 3.5}
PLACEHOLDER = 128
# The allow-list: harmless shapes of runs, and words in spans.
SHAPES = (
    r"^[0-9_=+/-]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(?:[A-Za-z]{0,15}[0-9]{0,4}[-/_=+]+)*+[A-Za-z]{0,15}[0-9]{0,4}$",
    r"^[A-Za-z]+[0-9]{1,4}$",
    r"^(?:[a-z_/+=-]+|[A-Z_/+=-]+)$",
    r"^(?:[-/_=+]*[A-Z]{0,4}[a-z]{2,})*+[A-Z]{0,4}[-/_=+]*$",
)
PLACEHOLDERS = r"(?i)(?:example|placeholder|changeme|your[_-]|xxxx|abcdefgh|12345678)"
BLOCK = 256

SPAN = "array<struct<start:int,kind:int,end:int,word:string>>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for a value that is computed once (a lambda over an array of one)."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _before(items: str, value: str, join: str, zero: str, kind: str) -> str:
    """SQL: for each of ``items`` (a name), what ``join`` makes of the ``value`` of all items before it (of x, from zero on).

    Sums of blocks first, then within blocks: the work grows little faster than the items.
    """
    joined = lambda a, b: join.format(a=a, b=b)
    step = f"named_struct('at', {joined('a.at', value)}, 'out', concat(a.out, array(a.at)))"
    inner = f"aggregate(block, named_struct('at', start, 'out', cast(array() as array<{kind}>)), (a, x) -> {step}, a -> a.out)"
    starts = f"transform(sums, (s, n) -> aggregate(slice(sums, 1, n), {zero}, (a, x) -> {joined('a', 'x')}))"
    sums = f"transform(blocks, block -> aggregate(block, {zero}, (a, x) -> {joined('a', value)}))"
    blocks = f"transform(sequence(0, (size({items}) - 1) div {BLOCK}), n -> slice({items}, n * {BLOCK} + 1, {BLOCK}))"
    return _let("blocks", blocks, _let("sums", sums, f"flatten(zip_with(blocks, {starts}, (block, start) -> {inner}))"))


def _places(text: str, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches as (start, kind, end, the match); code points, end exclusive."""
    p = _quoted(pattern)
    parts = f"zip_with(slice(split({text}, {p}, -1), 1, size(words)), words, (g, m) -> named_struct('gap', length(g), 'long', length(m), 'word', m))"
    spans = f"zip_with(parts, {_before('parts', 'x.gap + x.long', '{a} + {b}', '0', 'int')}, (x, at) -> named_struct('start', at + x.gap, 'kind', {kind}, 'end', at + x.gap + x.long, 'word', x.word))"
    walk = _let("words", f"regexp_extract_all({text}, {p}, 0)", _let("parts", parts, spans))
    return F.expr(f"if({text} rlike {p}, {walk}, cast(array() as {SPAN}))")


def _windows(word: str) -> str:
    """SQL: spans (a, b), relative to the run, of the windows whose entropy reaches the class's bound."""
    w = WINDOW
    # p: the run's character codes, its bound, and c * log2(c) at position c + 1
    terms = "array(0D, " + ", ".join(f"{c * math.log2(c)!r}D" for c in range(1, w + 2)) + ")"
    classes = {"hex": "^([0-9a-f]+|[0-9A-F]+)$", "lower": "^[0-9a-z]+$", "upper": "^[0-9A-Z]+$", "letters": "^[A-Za-z]+$"}
    bound = "case " + " ".join(f"when {word} rlike '{shape}' then {BOUNDS[k]}D" for k, shape in classes.items()) + f" else {BOUNDS['mixed']}D end"
    p = f"named_struct('codes', transform(split({word}, ''), x -> instr('{ALPHABET}', x)), 'bound', {bound}, 'term', {terms})"
    # windows by blocks, each with fresh counts from the block's first window on; x: the place in the block, the code that
    # comes in and the one that leaves (0: none); n_in: its count once the other has left
    steps = f"transform(slice(p.codes, first + 1, {BLOCK + w - 1}), (c, i) -> named_struct('i', i + 1, 'come', c, 'leave', if(i >= {w}, element_at(p.codes, first + i - {w - 1}), 0)))"
    n_out, n_in = "element_at(a.counts, x.leave)", "(element_at(a.counts, x.come) - if(x.come = x.leave, 1, 0))"
    counts = "transform(a.counts, (n, k) -> n + if(k + 1 = x.come, 1, 0) - if(k + 1 = x.leave, 1, 0))"
    total = (
        f"a.total + if(x.leave > 0, element_at(p.term, {n_out}) - element_at(p.term, {n_out} + 1), 0D)"
        f" + element_at(p.term, {n_in} + 2) - element_at(p.term, {n_in} + 1)"
    )
    hit = f"x.i >= {w} and log2({w}D) - b.total / {w} >= p.bound - 1e-9D"
    step = _let("b", f"named_struct('counts', {counts}, 'total', {total})", f"named_struct('counts', b.counts, 'total', b.total, 'hits', if({hit}, concat(a.hits, array(first + x.i)), a.hits))")
    zero = f"named_struct('counts', array_repeat(0, {len(ALPHABET)}), 'total', 0D, 'hits', cast(array() as array<int>))"
    ends = f"flatten(transform(sequence(0, size(p.codes) - {w}, {BLOCK}), first -> aggregate({steps}, {zero}, (a, x) -> {step}, a -> a.hits)))"
    # windows that touch or overlap are one span: it begins and ends where the next one is further away
    first = f"filter(hits, (h, i) -> i = 0 or h - element_at(hits, greatest(i, 1)) > {w})"
    last = f"filter(hits, (h, i) -> i = size(hits) - 1 or element_at(hits, least(i + 2, size(hits))) - h > {w})"
    return _let("p", p, _let("hits", ends, f"zip_with({first}, {last}, (a, b) -> named_struct('a', a - {w}, 'b', b))"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``base`` (spans of the patterns) and ``found`` (with those of the entropy), ordered by start and kind."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    df = df.select(
        "doc_id",
        F.filter(_places("t", ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["word"], "^(?:" + ASSIGN + ")$", 2)) >= ASSIGN_LEAST).alias("assign"),
        _places("t", ACCESS, 1).alias("access"),
        _places("t", HEX, 2).alias("hex"),
        _places("t", CANDIDATE, 3).alias("runs"),
    )
    shaped = " or ".join(f"x.word rlike {_quoted(p)}" for p in SHAPES)
    df = df.select("doc_id", "assign", "access", "hex", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), F.expr(f"filter(runs, x -> not ({shaped}))").alias("runs"))
    spans = (
        f"flatten(transform(runs, x -> {_let('chars', "split(x.word, '')", f"transform({_windows('x.word')}, h -> named_struct('start', x.start + h.a, 'kind', 3, 'end', x.start + h.b, "
        f"'word', if(h.b - h.a <= {PLACEHOLDER}, array_join(slice(chars, h.a + 1, h.b - h.a), ''), '')))")}))"
    )
    spans = f"filter({spans}, x -> not x.word rlike {_quoted(PLACEHOLDERS)})"
    df = df.withColumn("more", F.expr(f"if(size(runs) > 0, {spans}, cast(array() as {SPAN}))"))
    # in the order of starts, a span is new if no pattern's span up to it goes as far
    inside = _let("both", "array_sort(concat(base, more))", f"filter(zip_with(both, {_before('both', 'if(x.kind < 3, x.end, 0)', 'greatest({a}, {b})', '0', 'int')}, (x, upto) -> named_struct('x', x, 'new', x.kind < 3 or x.end > upto)), z -> z.new)")
    found = F.expr(f"if(size(more) > 0, transform({inside}, z -> z.x), base)")
    return df.select("doc_id", "assign", "access", "hex", "base", found.alias("found"))


def spelled(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at(array('assign', 'access', 'hex', 'entropy'), x.kind + 1), x.start, x.end)), ',')")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each pattern, the digest of their spans, and all spans, for every row."""
    return scan(docs, doc_id, text).select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(spelled("base").cast("binary"), 256).alias("base_sha256"),
        spelled("found").alias("spans"),
    )
