"""The graph's tables in plain SQL, as common table expressions, for comparison with other engines."""

from __future__ import annotations

import re

from .dna import AS_BASES, LETTERS, TABLES

STEP = 256


def code(s: str) -> str:
    return f"translate({s}, 'CATG', '0123')"


def rc(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


def canon(s: str) -> str:
    return f"CASE WHEN {code(s)} >= {code(rc(s))} THEN {s} ELSE {rc(s)} END"


def packed(s: str, k: int) -> str:
    return "(" + " + ".join(f"substr({code(s)}, {i + 1}, 1)::BIGINT * {4 ** (k - 1 - i)}" for i in range(k)) + ")"


def constant(s: str) -> str:
    return f"({s} = repeat(left({s}, 1), length({s})))"


def duplex(s: str) -> str:
    return f"({s} = {rc(s)} OR {constant(s)})"


def kmers(k: int, table: str = "documents", tag: str = "") -> str:
    """reads, frags and kmers(read_id, frag, pos, n, kmer, edge) of a table, their names ending in tag."""
    return f"""
reads{tag} AS (SELECT {TABLES[table]} AS read_id, translate(regexp_replace(coalesce(text, ''), '[^a-z]+', '', 'g'), '{LETTERS}', '{AS_BASES}') AS seq, row_number() OVER () AS rid FROM {table}),
runs{tag} AS (SELECT read_id, rid, [x FOR x IN regexp_split_to_array(seq, '[^ACGT]+') IF x <> ''] AS l FROM reads{tag}),
frags{tag} AS (SELECT read_id, rid, unnest(l) AS seq, unnest(range(len(l))) AS frag FROM runs{tag}),
parts{tag} AS (SELECT read_id, rid, frag, length(seq) AS n, c * {STEP} AS off, substr(seq, (c * {STEP} + 1)::BIGINT, {STEP + k - 1}) AS s
  FROM (SELECT *, unnest(range(0, (length(seq) - {k}) // {STEP} + 1)) AS c FROM frags{tag} WHERE length(seq) >= {k})),
raw{tag} AS (SELECT read_id, rid, frag, off + i AS pos, n, substr(s, (i + 1)::BIGINT, {k}) AS kmer FROM (SELECT *, unnest(range(0, length(s) - {k} + 1)) AS i FROM parts{tag})),
kmers{tag} AS (SELECT *, {canon('kmer')} AS edge FROM raw{tag})"""


def edges(k: int, table: str = "documents", tag: str = "") -> str:
    """raw, as in kmers, and edges(edge, cnt): windows are counted as read, then once more by their canonical form."""
    windows = kmers(k, table, tag).rpartition(",\nkmers")[0]
    return windows + f",\nseen{tag} AS (SELECT kmer, count(*) AS n FROM raw{tag} GROUP BY kmer),\nedges{tag} AS (SELECT {canon('kmer')} AS edge, sum(n)::BIGINT AS cnt FROM seen{tag} GROUP BY 1)"


def incidence(k: int) -> str:
    n = k - 1
    return f""",
ends2 AS (SELECT edge, cnt, left(edge, {n}) AS pre, right(edge, {n}) AS suf, {canon(f'left(edge, {n})')} AS l, {canon(f'right(edge, {n})')} AS r FROM edges),
pairs AS (SELECT *, l AS node, r AS neighbor FROM ends2 UNION ALL SELECT *, r AS node, l AS neighbor FROM ends2 WHERE l <> r),
inc AS (SELECT node, edge, cnt, neighbor, CASE WHEN l = r THEN 2 ELSE 1 END AS w,
  CASE WHEN (suf = node OR pre = {rc('node')}) AND (pre = node OR suf = {rc('node')}) THEN 'D' WHEN suf = node OR pre = {rc('node')} THEN 'L' ELSE 'R' END AS side FROM pairs)"""


def ends(k: int) -> str:
    n = k - 1
    left, right = f"left(kmer, {n})", f"right(kmer, {n})"
    return f""",
marks AS (
  SELECT {left} AS nd, kmer, n FROM seen WHERE {duplex(left)}
  UNION ALL SELECT {right}, kmer, n FROM seen WHERE {duplex(right)}
  UNION ALL SELECT {left}, kmer, 1 FROM raw WHERE pos = 0 AND NOT {duplex(left)}
  UNION ALL SELECT {right}, kmer, 1 FROM raw WHERE pos = n - {k} AND NOT {duplex(right)}),
marked AS (SELECT {canon('nd')} AS node, {canon('kmer')} AS edge, n FROM marks),
sided AS (SELECT node, n, (right(edge, {n}) = node OR left(edge, {n}) = {rc('node')}) AS isl, (left(edge, {n}) = node OR right(edge, {n}) = {rc('node')}) AS isr FROM marked),
ends AS (SELECT node, coalesce(sum(n) FILTER (isl AND NOT isr), 0)::BIGINT AS left_ends, coalesce(sum(n) FILTER (isr AND NOT isl), 0)::BIGINT AS right_ends FROM sided GROUP BY node HAVING count(*) FILTER (isl <> isr) > 0)"""


def low(v: str, n: int, bits: int) -> str:
    """(v << n) mod 2**bits"""
    return f"(({v} & {(1 << (bits - n)) - 1}) << {n})" if n < bits else "0"


def mix(v: str, bits: int) -> list[tuple[str, str]]:
    """Steps (name, expression) of the invertible mix."""
    m = (1 << bits) - 1
    return [
        ("m1", f"((xor({m}, {v}) + {low(v, 21, bits)}) & {m})"),
        ("m2", "xor(m1, m1 >> 24)"),
        ("m3", f"((m2 + {low('m2', 3, bits)} + {low('m2', 8, bits)}) & {m})"),
        ("m4", "xor(m3, m3 >> 14)"),
        ("m5", f"((m4 + {low('m4', 2, bits)} + {low('m4', 4, bits)}) & {m})"),
        ("m6", "xor(m5, m5 >> 28)"),
        ("hash", f"((m6 + {low('m6', 31, bits)}) & {m})"),
    ]


def chain(first: str, steps: list[tuple[str, str]], tag: str = "s") -> str:
    """Expressions one after another; the last table is {tag}{len(steps)}."""
    return ", ".join([f"{tag}0 AS ({first})", *[f"{tag}{i + 1} AS (SELECT *, {x} AS {n} FROM {tag}{i})" for i, (n, x) in enumerate(steps)]])


def rc_number(v: str, k: int) -> str:
    return "(" + " + ".join(f"((3 - (({v} >> {2 * i}) & 3)) << {2 * (k - 1 - i)})" for i in range(k)) + ")"


def canon_number(v: str, k: int) -> str:
    return f"greatest({v}, {rc_number(v, k)})"


def unpacked(v: str, k: int) -> str:
    return "(" + " || ".join(f"substr('CATG', ((({v}) >> {2 * (k - 1 - i)}) & 3)::INT + 1, 1)" for i in range(k)) + ")"


def signed(h: str) -> str:
    return f"(CASE WHEN {h} >= 9223372036854775808 THEN ({h}::HUGEINT - 18446744073709551616)::BIGINT ELSE {h}::BIGINT END)"


def multiplied(h: str, by: int) -> str:
    """h * by mod 2**64 of an unsigned h"""
    return f"(({h}::UHUGEINT * {by}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def multiply_shift(e: str, bits: int) -> str:
    return f"((({e}) * 2654435761) % 4294967296) // {1 << (32 - bits)}"


def lossy(k: int, bits: int) -> str:
    """exact, sketch, step(node, e, occ, neighbor) of all nodes that there could be, walk(node) and found(e, occ), on numbers."""
    n = k - 1
    return f""",
exact AS (SELECT {packed('edge', k)} AS e, cnt FROM edges),
sketch AS (SELECT {multiply_shift('e', bits)} AS hash, sum(cnt)::BIGINT AS cnt FROM exact GROUP BY 1),
all_nodes AS (SELECT i AS node FROM range({4**n}) t(i) WHERE i >= {rc_number('i', n)}),
around AS (SELECT node, CASE WHEN s = 0 THEN node * 4 + b ELSE b * {4**n} + node END AS x FROM all_nodes, range(4) u(b), range(2) v(s)),
cand AS (SELECT DISTINCT node, {canon_number('x', k)} AS e FROM around),
shown AS (SELECT node, e, sketch.cnt AS occ, {canon_number('(e >> 2)', n)} AS l, {canon_number(f'(e & {4**n - 1})', n)} AS r FROM cand JOIN sketch ON sketch.hash = {multiply_shift('e', bits)}),
step AS (SELECT node, e, occ, CASE WHEN l = node THEN r ELSE l END AS neighbor FROM shown),
walk AS (SELECT {packed('node', n)} AS node FROM ends UNION SELECT neighbor FROM step JOIN walk USING (node)),
found AS (SELECT DISTINCT e, occ FROM step JOIN walk USING (node))"""


def once(query: str) -> str:
    """The query with each table expression worked out once, but recursive ones."""
    return re.sub(r"\b(?!walk\b|near\b)(\w+(?:\([^()]*\))?) AS \((?=\s*SELECT)", r"\1 AS MATERIALIZED (", query)
