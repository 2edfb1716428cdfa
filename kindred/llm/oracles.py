"""The queries that SQL can express whole, for a second engine over the same tables."""

from __future__ import annotations

from .reply_trees import LOSS_ROLE, START, STOP
from .secret_scan import ACCESS_LEAST, ASSIGN_LEAST, BASE_KINDS, HEX_LEAST
from .spot_signatures import COMMON
from .substring_dedup import LENGTH

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _kind(name: str, pattern: str, good: str) -> str:
    """A kind's matches, one after the other in what is left of each text. A match is found where its text first occurs:
    were it there earlier, the pattern would match earlier."""
    return f"""{name}_m as (select doc_id, rest, pos, regexp_extract(rest, '{pattern}') m from (select doc_id, coalesce(text, '') rest, 0::bigint pos from documents)
        union all select doc_id, rest, pos, regexp_extract(rest, '{pattern}') from (select doc_id, substr(rest, instr(rest, m) + length(m)) rest, pos + instr(rest, m) + length(m) - 1 pos from {name}_m where m <> '')),
      {name}_s as (select doc_id, pos + instr(rest, m) - 1 s, pos + instr(rest, m) - 1 + length(m) e from {name}_m where m <> '' and {good})"""


_keywords = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_assign = rf"""({_keywords})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_kinds = [
    _kind("assign", _assign, f"length(regexp_extract(m, '{_assign}', 2)) >= {ASSIGN_LEAST}"),
    # A maximal run that is too short holds none that is long enough, so that these patterns may ask for the length.
    _kind("access", f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", "true"),
    _kind("hex", f"[0-9a-f]{{{HEX_LEAST},}}", "true"),
]
_each_kind = " union all ".join(f"select doc_id, {i} k, '{k}' kind, s, e from {k}_s" for i, k in enumerate(BASE_KINDS))
_kind_counts = ", ".join(f"count(*) filter (where kind = '{k}') n_{k}" for k in BASE_KINDS)
#: The spans of the kinds with checksums are not said here: the tables hold none, as the query's result shows.
SECRETS = f"""with recursive {", ".join(_kinds)}, spans as ({_each_kind}),
    told as (select doc_id, {_kind_counts}, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) spans from spans group by 1)
    select doc_id, {", ".join(f"coalesce(n_{k}, 0) n_{k}" for k in BASE_KINDS)}, sha256(coalesce(spans, '')) base_sha256, coalesce(spans, '') spans from documents left join told using (doc_id)"""

_LEVELS = 11
_windows = f"range(1, len(w) - {LENGTH - 2})"
_longer = ", ".join(
    f"""c{n} as (select a.doc_id, a.p, md5(a.h || b.h) h from l{n - 1} a join l{n - 1} b on a.doc_id = b.doc_id and b.p = a.p + {LENGTH << n - 1}),
    l{n} as materialized (select doc_id, p, h from c{n} where h in (select h from c{n} group by 1 having count(distinct doc_id) > 1))"""
    for n in range(1, _LEVELS)
)
_each_level = " union all ".join(f"select distinct doc_id, {LENGTH << n} n from l{n}" for n in range(_LEVELS))
SUBSTRINGS = rf"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') w from documents),
    g as (select doc_id, unnest({_windows}) p, unnest(list_transform({_windows}, lambda p: array_to_string(w[p:p + {LENGTH - 1}], ' '))) k from d where len(w) >= {LENGTH}),
    shared as (select k, min(doc_id) least from g group by 1 having count(distinct doc_id) > 1),
    l0 as materialized (select doc_id, p, md5(k) h, doc_id > least later from g join shared using (k)),
    covered as (select distinct doc_id, unnest(range(p, p + {LENGTH})) i from l0 where later), {_longer},
    most as (select doc_id, max(n) longest from ({_each_level}) group by 1),
    kept as (select doc_id, count(*) n_kept, string_agg(word, ' ' order by i) kept from (select doc_id, unnest(w) word, generate_subscripts(w, 1) i from d) x anti join covered using (doc_id, i) group by 1)
    select doc_id, len(w) n_words, len(w) - coalesce(n_kept, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256, coalesce(longest, 0) longest from d left join kept using (doc_id) left join most using (doc_id)"""

_threes = "list_transform(range(1, len(w) - 1), lambda p: array_to_string(w[p:p + 2], ' '))"
JACCARD = rf"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') w from documents),
    sh as materialized (select distinct doc_id, unnest(case when len(w) >= 3 then {_threes} when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from d),
    sizes as (select doc_id, count(*) n from sh group by 1),
    met as (select a.doc_id x, b.doc_id y, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
    link as materialized (select x, y from met join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
    both_ as materialized (select x, y from link union all select y, x from link),
    reach as (select doc_id x, doc_id y from d union select reach.x, both_.y from reach join both_ on both_.x = reach.y),
    home as (select x doc_id, min(y) component_id from reach group by 1), links as (select x doc_id, count(*) n_links from both_ group by 1)
    select doc_id, coalesce(n, 0) n_shingles, component_id, coalesce(n_links, 0) n_links from d left join sizes using (doc_id) join home using (doc_id) left join links using (doc_id)"""

_common = ", ".join(f"'{w}'" for w in sorted({w for words in COMMON.values() for w in words.split()}))
_clean = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_words = "list_concat(['^'], list_filter(string_split(s, ' '), lambda v: v <> ''))"
_upto = "sum(length(word) + 1) over (partition by r, side order by i)"
_likeness = "len(list_intersect(o.f, {0}.f))::double / len(list_distinct(list_concat(o.f, {0}.f)))"
SPOTS = f"""with d as (select doc_id, coalesce(text, '') t, row_number() over (order by doc_id, coalesce(text, '')) r, count(*) over () n from documents),
    x as (select a.doc_id, a.r, a.t, b.r nr, left(a.t, length(a.t) - length(a.t) // 2) || left(b.t, length(a.t) // 2) edited from d a join d b on b.r = case when a.r = a.n then 1 else a.r + 1 end),
    texts as materialized (select r, 0 side, {_clean.format("t")} s from x union all select r, 1, {_clean.format("edited")} from x),
    w as (select r, side, unnest({_words}) word, generate_subscripts({_words}, 1) i from texts),
    p as (select r, side, i, i = 1 or word in ({_common}) anchor, {_upto} - length(word) a, {_upto} - 1 z from w),
    q as materialized (select *, sum((not anchor)::int) over (partition by r, side order by i) k from p),
    c as (select r, side, k, z from q where not anchor),
    m as (select q.r, q.side, q.a, coalesce(c2.z, c1.z) z from q join c c1 on c1.r = q.r and c1.side = q.side and c1.k = q.k + 1 left join c c2 on c2.r = q.r and c2.side = q.side and c2.k = q.k + 2 where anchor),
    sig as (select m.r, m.side, list_sort(list_distinct(list(substr(md5(substr('^ ' || s, a::bigint, (z - a + 1)::bigint)), 1, 16)))) f from m join texts on texts.r = m.r and texts.side = m.side group by 1, 2),
    f as materialized (select r, side, coalesce(f, [substr(md5(' ^ ' || s || ' '), 1, 16)]) f from texts left join sig using (r, side))
    select doc_id, length(t) n_chars, sha256(edited) edited_sha256, array_to_string(o.f, ',') fingerprint, array_to_string(e.f, ',') edited_fingerprint, {_likeness.format("e")} near_edited, {_likeness.format("b")} near_next
    from x join f o on o.r = x.r and o.side = 0 join f e on e.r = x.r and e.side = 1 join f b on b.r = x.nr and b.side = 0"""

_said = "<|im_end|><|im_start|>assistant ok"
_loss = f"filter (where r = '{LOSS_ROLE}')"
TREES = rf"""with m as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations union all values (-1, 0, 'user', '{_said}'), (-1, 1, 'assistant', '{_said}')),
    x as (select *, regexp_replace(t, '<(\\*)\|', '<\1\\|', 'g') et, replace(regexp_replace(r, '<(\\*)(n?)\|', '<\1\\\2|', 'g'), chr(10), '<n|') er from m)
    select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256, coalesce(sum(length(t)) {_loss}, 0)::bigint loss_chars,
      sha256(coalesce(string_agg(t, '' order by turn, r, t) {_loss}, '')) loss_sha256, sum({len(START) + 1 + len(STOP)} + length(er) + length(et))::bigint formatted_chars from x group by 1"""

ORACLES: dict[str, str] = {"op1_secret_scan": SECRETS, "op4_substring_dedup": SUBSTRINGS, "op5_jaccard_join": JACCARD, "op8_spot_signatures": SPOTS, "op9_reply_trees": TREES}
