"""DuckDB SQL fragments restating the operators, for the correctness oracle.

These build SQL text only; nothing here runs Spark.  RE2 has no look-around
or back-references in patterns, so some rules are spelled differently from
the Spark expressions (same results).
"""

from __future__ import annotations

from tessera.functions import fixed_values as fv
from tessera.functions.text import WS_CLASS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WS_CLASS + '+')}, ' ', 'g'), ' ')"


def fillers(x: str) -> str:
    words = ", ".join(q(w) for w in fv.FILLER_WORDS)
    return f"array_to_string(list_filter(string_split({x}, ' '), lambda w: w NOT IN ({words})), ' ')"


def punct(x: str) -> str:
    return (f"translate(regexp_replace({x}, '([,.?!:;]) ', '\\1', 'g'), "
            f"{q(fv.ASCII_MARKS)}, {q(fv.FULL_WIDTH_MARKS)})")


def dedup(x: str) -> str:
    for mark in fv.DEDUP_MARKS:
        x = f"regexp_replace({x}, {q(mark + '{2,}')}, {q(mark)}, 'g')"
    return x


def doc_clean(x: str) -> str:
    base = collapse(f"coalesce({x}, '')")
    return f"trim({dedup(punct(fillers(base)))}, ' ')"


def segment_clean(x: str) -> str:
    base = collapse(f"coalesce({x}, '')")
    return f"regexp_replace({base}, '([。，])[。，]+', '\\1', 'g')"


TRAD = q(fv.TRADITIONAL_CHARS)
SIMP = q(fv.SIMPLIFIED_CHARS)


def simplify(x: str) -> str:
    return f"translate({x}, {TRAD}, {SIMP})"


def traditionalise(x: str) -> str:
    return f"translate({x}, {SIMP}, {TRAD})"


def bucket(w: str, dim: int) -> str:
    return f"(('0x' || substr(md5({w}), 1, 8))::BIGINT % {dim})"


def sparse_hash_embedding(table_sql: str, id_col: str, text_col: str, dim: int = 64) -> str:
    """SQL yielding ``(id, bucket, weight)`` of the hashing embedder (non-zero buckets)."""
    return f"""
    (WITH toks AS (
        SELECT {id_col} AS id, unnest(regexp_split_to_array(lower(coalesce({text_col}, '')), '[^\\p{{L}}\\p{{N}}]+')) AS w
        FROM {table_sql}),
     cnt AS (SELECT id, {bucket('w', dim)} AS bucket, count(*)::DOUBLE AS c FROM toks WHERE w <> '' GROUP BY ALL),
     nrm AS (SELECT id, sqrt(sum(c * c)) AS n FROM cnt GROUP BY id)
     SELECT cnt.id, cnt.bucket, cnt.c / greatest(nrm.n, 1e-12) AS weight FROM cnt JOIN nrm USING (id))"""


def host(url: str) -> str:
    return f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"


def any_contains(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(n)})" for n in needles) + ")"


def allowed_domain(url: str) -> str:
    return any_contains(f"lower({url})", fv.ALLOWED_DOMAINS)


def supported_host(url: str) -> str:
    h = f"lower({host(url)})"
    return (f"(regexp_matches({url}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') AND {h} <> '' AND "
            f"{any_contains(h, fv.ALLOWED_DOMAINS)})")


def is_playlist(url: str) -> str:
    return any_contains(f"lower({url})", fv.PLAYLIST_PATTERNS)


def is_channel(url: str) -> str:
    return any_contains(f"lower({url})", fv.CHANNEL_PATTERNS)


def url_kind(url: str) -> str:
    return (f"CASE WHEN {is_playlist(url)} THEN 'playlist' WHEN {is_channel(url)} THEN 'channel' "
            f"ELSE 'item' END")


def playlist_id(url: str) -> str:
    query = f"regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1)"
    raw = f"regexp_extract({query}, '(?:^|&)list=([^&]+)', 1)"
    return f"nullif(url_decode(replace({raw}, '+', ' ')), '')"


def last_segment(url: str) -> str:
    return f"string_split({url}, '/')[-1]"


# ---- derived fixtures (FIXTURES.md §B) ------------------------------------------------
SEGMENTS = """(SELECT conv_id AS transcript_id, CAST(turn AS INTEGER) AS seg_idx, text,
        CAST(turn * 10 AS DOUBLE) AS start_time, CAST((turn + 1) * 10 AS DOUBLE) AS end_time,
        CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(-turn AS DOUBLE) / 10 END AS confidence
   FROM conversations)"""

URLS = """(SELECT page_id AS url_ord, CASE page_id % 6
        WHEN 0 THEN 'https://www.youtube.com/playlist?list=' || CAST(page_id % 50 AS VARCHAR)
        WHEN 1 THEN 'https://www.youtube.com/channel/' || CAST(page_id % 50 AS VARCHAR)
        WHEN 2 THEN 'https://www.youtube.com/watch?v=x&list=' || CAST(page_id % 50 AS VARCHAR)
        WHEN 3 THEN 'https://b23.tv/' || CAST(page_id AS VARCHAR)
        WHEN 4 THEN 'https://evil.example/bilibili.com/' || CAST(page_id AS VARCHAR)
        ELSE url END AS url FROM pages)"""

CATALOGUE = """(SELECT CAST(l_orderkey AS VARCHAR) AS container_id,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS pos,
        CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS item_id
   FROM lineitem)"""

MEDIA = """(SELECT CAST(o_orderkey AS VARCHAR) AS file_path,
        CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE round(o_totalprice / 1000, 3) END AS duration,
        CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey END AS size_bytes
   FROM orders)"""

LISTING = "(SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS file_path FROM lineitem)"

CJK = f"(SELECT doc_id, lang, translate(text, 'abcdefgh', '這個來過時間問題') AS t FROM documents)"
REPEATED = "(SELECT doc_id, replace(replace(text, ', ', ',,, '), '. ', '... ') AS t FROM documents)"
FULL_WIDTH = f"(SELECT doc_id, translate(t, ',.', '，。') AS t FROM {REPEATED})"
FILLERS = "(SELECT doc_id, replace(text, ' the ', ' 然后 ') AS t FROM documents)"


# ---- chunker (G1, P7, F19) restated in DuckDB list SQL --------------------------------
def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS_CLASS + '+|' + WS_CLASS + '+$')}, '', 'g')"


def _split_keep(s: str, sep: str) -> str:
    if sep == "":
        return f"string_split({s}, '')"
    return (f"list_transform(string_split({s}, {q(sep)}), "
            f"lambda x, i: CASE WHEN i = 1 THEN x ELSE {q(sep)} || x END)")


def _node(size: int, seps) -> str:
    n = len(seps)
    conds = " ".join(
        f"WHEN pe.k <= {i}{'' if sep == '' else f' AND contains(pe.s, {q(sep)})'} THEN {i}"
        for i, sep in enumerate(seps))
    found = f"CASE {conds} ELSE -1 END"
    cont = ", ".join(str(i) for i, sep in enumerate(seps) if sep != "" and i < n - 1) or "-99"
    j = f"(CASE WHEN jf < 0 THEN {n - 1} ELSE jf END)"
    branches = " ".join(f"WHEN {i} THEN {_split_keep('pe.s', sep)}" for i, sep in enumerate(seps))
    children = f"list_filter(CASE {j} {branches} END, lambda c: c <> '')"
    child = (f"{{'s': c, 'k': {j} + 1, "
             f"'g': CASE WHEN length(c) < {size} THEN pe.g ELSE pe.g || '.' || CAST(i - 1 AS VARCHAR) END, "
             f"'done': length(c) < {size} OR NOT (jf IN ({cont}))}}")
    return f"list_transform([{found}], lambda jf: list_transform({children}, lambda c, i: {child}))[1]"


def chunk_sql(source: str, size: int = 1000, overlap: int = 200, separators=None,
              min_size: int | None = None) -> str:
    """DuckDB SQL: chunks of ``source(id, cleaned, s0, e1)``.

    Yields ``(id, chunk_index, text, start_time, end_time)``.  Same algorithm
    as ``operators.chunking`` (recursive split, per-node greedy merge with
    overlap, strip, P7, F19), written with DuckDB list functions.
    """
    seps = list(separators if separators is not None else fv.SEPARATORS)
    min_size = min_size if min_size is not None else max(100, size // 10)
    init = "[{'s': cleaned, 'k': 0, 'g': '', 'done': false}]"
    level = (f"CASE WHEN len(list_filter(p, lambda pe: NOT pe.done)) > 0 THEN flatten(list_transform(p, "
             f"lambda pe: CASE WHEN pe.done THEN [pe] ELSE {_node(size, seps)} END)) ELSE p END")
    ctes = [f"l0 AS (SELECT id, cleaned, s0, e1, {init} AS p FROM {source})"]
    for i in range(1, len(seps) + 1):
        ctes.append(f"l{i} AS (SELECT id, cleaned, s0, e1, {level} AS p FROM l{i - 1})")
    last = f"l{len(seps)}"
    emit = ("CASE WHEN {a}.total > 0 THEN list_append({a}.chunks, {{'off': {a}.off, 'len': {a}.total}}) "
            "ELSE {a}.chunks END")
    pop = (f"list_reduce(lens[acc.a + 1 : x.i], lambda st, ln: CASE WHEN NOT st.stop AND "
           f"(st.total > {overlap} OR (st.total + x.len > {size} AND st.total > 0)) "
           f"THEN {{'a': st.a + 1, 'off': st.off + ln, 'total': st.total - ln, 'stop': false}} "
           f"ELSE {{'a': st.a, 'off': st.off, 'total': st.total, 'stop': true}} END, "
           f"{{'a': acc.a, 'off': acc.off, 'total': acc.total, 'stop': false}})")
    merge = (f"CASE WHEN acc.g IS NULL OR acc.g <> x.g THEN "
             f"{{'chunks': {emit.format(a='acc')}, 'a': x.i, 'off': acc.off + acc.total, 'total': x.len, 'g': x.g}} "
             f"WHEN acc.total + x.len > {size} AND acc.total > 0 THEN list_transform([{pop}], lambda st: "
             f"{{'chunks': {emit.format(a='acc')}, 'a': st.a, 'off': st.off, 'total': st.total + x.len, 'g': acc.g}})[1] "
             f"ELSE {{'chunks': acc.chunks, 'a': acc.a, 'off': acc.off, 'total': acc.total + x.len, 'g': acc.g}} END")
    init_acc = ("{'chunks': []::STRUCT(off BIGINT, len BIGINT)[], 'a': 0::BIGINT, 'off': 0::BIGINT, "
                "'total': 0::BIGINT, 'g': NULL::VARCHAR}")
    items = "list_transform(p, lambda q, i: {'len': length(q.s)::BIGINT, 'g': q.g, 'i': (i - 1)::BIGINT})"
    ctes.append(f"lk AS (SELECT id, cleaned, s0, e1, p, list_transform(p, lambda q: length(q.s)::BIGINT) AS lens "
                f"FROM {last})")
    ctes.append(f"sp AS (SELECT id, cleaned, s0, e1, list_transform([list_reduce({items}, lambda acc, x: {merge}, "
                f"{init_acc})], lambda r: {emit.format(a='r')})[1] AS spans FROM lk)")
    texts = (f"list_filter(list_transform(spans, lambda c: {strip('substr(cleaned, c.off + 1, c.len)')}), "
             f"lambda t: t <> '')")
    ctes.append(f"ch AS (SELECT id, cleaned, s0, e1, length(cleaned) < {min_size} AS short, "
                f"CASE WHEN length(cleaned) < {min_size} THEN [cleaned] ELSE {texts} END AS ch FROM sp)")
    ctes.append("ro AS (SELECT id, cleaned, s0, e1, short, ch[i] AS text, CAST(i - 1 AS INTEGER) AS chunk_index "
                "FROM ch, range(1, len(ch) + 1) r(i))")
    ctes.append(f"kp AS (SELECT * FROM ro WHERE short OR length({strip('text')}) >= {min_size})")
    ctes.append(f"tp AS (SELECT *, instr(cleaned, substr({strip('text')}, 1, {fv.TIME_MATCH_PREFIX})) - 1 AS pos, "
                f"CASE WHEN e1 <> s0 THEN length(cleaned) / (e1 - s0) END AS cps FROM kp)")
    ctes.append("tt AS (SELECT *, s0 + pos / cps AS st FROM tp)")
    ctes.append("tu AS (SELECT *, st + length(text) / cps AS en FROM tt)")
    body = ("SELECT id, chunk_index, text, "
            "CASE WHEN short THEN s0 WHEN pos >= 0 AND st IS NOT NULL AND en IS NOT NULL THEN greatest(s0, st) "
            "ELSE s0 END AS start_time, "
            "CASE WHEN short THEN e1 WHEN pos >= 0 AND st IS NOT NULL AND en IS NOT NULL THEN least(e1, en) "
            "ELSE e1 END AS end_time FROM tu")
    return "WITH " + ",\n".join(ctes) + "\n" + body
