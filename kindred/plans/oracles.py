"""The linkage queries as SQL for a second engine over the same tables: WITH clauses that build on each other."""

from __future__ import annotations

import numpy as np

from ..functions.text import script_table
from ..operators.features import FEATURES, PERCENTILES
from ..operators.scoring import FORMULAS, SIGNALS
from .queries import CUTOFF, PLACES, RESULT_LINES

SPACE = r"[\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]+"


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(nfc_normalize(lower(coalesce({x}, ''))), '\p{{P}}', ' ', 'g'), '{SPACE}', ' ', 'g'))"


def _grams(n: int, column: str = "name") -> str:
    compact = f"replace({column}, ' ', '')"
    return f"list_sort(list_distinct(list_transform(range(1, greatest(length({compact}) - {n - 2}, 1)), lambda i: substr({compact}, i, {n}))))"


def _r(x: str, alias: str) -> str:
    return f"round_even({x}, {PLACES}) as {alias}"


#: Named parts; a query takes those that it needs with all that they need.
PARTS: dict[str, tuple[str, str]] = {
    "w": ("", r"select doc_id, lang, n_chars, list_filter(string_split_regex(text, '[ \t\n\f\r]+'), lambda x: x <> '') t from documents"),
    "b": ("w", "select doc_id, lang, n_chars, t, array_to_string(t[1:4], ' ') nm, array_to_string(t[5:10], ' ') ad from w"),
    "raw": ("b", """select 'S1-' || doc_id entity_id, nm business_name, n_chars || ' ' || ad business_address, lang country, 1 src, doc_id seq from b where doc_id % 2 = 0
      union all select 'S2-' || doc_id, case doc_id % 10 when 0 then replace(nm, 'e', 'E') when 2 then array_to_string(list_reverse(t[1:4]), ' ') when 4 then 'x' || nm else nm end,
        case when doc_id % 14 = 0 then '' when doc_id % 6 = 0 then n_chars || ', ' || array_to_string(t[5:7], ' ') else (n_chars + doc_id % 3) || ' ' || ad end, lang, 2, doc_id from b where doc_id % 3 <> 1
      union all select 'S3-' || doc_id, case doc_id % 10 when 0 then array_to_string(t[2:4], ' ') when 6 then replace(nm, 'e', '') else nm end,
        case when doc_id % 22 = 0 then null else array_to_string(t[5:10], '-') || ' ' || n_chars end, lang, 3, doc_id from b where doc_id % 4 <> 2"""),
    "rec": ("raw", f"select entity_id, coalesce(business_name, '') business_name, coalesce(business_address, '') business_address, {_norm('country')} country, {_norm('business_name')} as name, {_norm('business_address')} address, src, seq from raw"),
    "prep": ("rec", r"""select *, list_filter(string_split(name, ' '), lambda x: x <> '') nt, list_distinct(list_filter(string_split(name, ' '), lambda x: x <> '')) ns,
      list_distinct(list_filter(string_split(address, ' '), lambda x: x <> '')) ads from rec"""),
    "full": ("prep", rf"select *, list_filter(ads, lambda x: regexp_full_match(x, '\p{{Nd}}+')) nums, list_filter(ads, lambda x: not regexp_full_match(x, '\p{{Nd}}+')) wds, {_grams(2)} bi, {_grams(3)} tri, {_grams(2, 'address')} abi from prep"),
    "q": ("full", "select * from full_ where src = 1"),
    "p": ("full", "select * from full_ where src > 1"),
    "truth": ("q p", "select q.entity_id s1_id, p.entity_id match_id from q join p on q.seq = p.seq"),
    "keys": ("full", """select entity_id, 'name_token' as rule, country, nt[1] as value from full_ where country <> '' and name <> ''
      union all select entity_id, 'address_number', country, unnest(nums) from full_ where country <> ''
      union all select entity_id, 'name_prefix', country, substr(name, 1, 4) from full_ where country <> '' and name <> ''"""),
    "hits": ("keys", "select distinct a.entity_id s1_id, b.entity_id cand_id, a.rule from keys a join keys b on a.rule = b.rule and a.country = b.country and a.value = b.value where a.entity_id like 'S1-%' and b.entity_id not like 'S1-%'"),
    "c": ("hits", "select distinct s1_id, cand_id from hits"),
    "docs": ("p", "select country, count(*) n from p group by country"),
    "toks": ("full", "select entity_id, src, country, 'name' as field, unnest(ns) term from full_ union all select entity_id, src, country, 'address', unnest(ads) from full_ union all select entity_id, src, country, 'grams', unnest(tri) from full_"),
    "terms": ("toks", "select field, country, term, count(*) df from toks where src > 1 group by all"),
    "rn": ("toks terms", "select distinct a.entity_id s1_id, b.entity_id cand_id from toks a join toks b using (field, country, term) join terms using (field, country, term) where field = 'name' and df <= 200 and country <> '' and a.src = 1 and b.src > 1"),
    "ra": ("toks terms", r"select a.entity_id s1_id, b.entity_id cand_id from toks a join toks b using (field, country, term) join terms using (field, country, term) where field = 'address' and df <= 300 and country <> '' and a.src = 1 and b.src > 1 and not regexp_full_match(term, '\p{Nd}+') group by all having count(*) >= 2"),
    "qg": ("toks terms", "select entity_id, country, term from (select *, row_number() over (partition by entity_id order by df, term) k from toks join terms using (field, country, term) where field = 'grams' and src = 1 and df <= 200 and country <> '') where k <= 4"),
    "rt": ("qg toks", "select qg.entity_id s1_id, b.entity_id cand_id from qg join toks b on b.field = 'grams' and b.src > 1 and b.country = qg.country and b.term = qg.term group by all having count(*) >= 2"),
    "ex": ("c rn ra rt", """select s1_id, cand_id, bool_or(o = 'c') in_c, bool_or(o = 't') in_tokens, bool_or(o = 'n') in_ngrams from
      (select *, 'c' o from c union all select *, 't' from rn union all select *, 't' from ra union all select *, 'n' from rt) group by all"""),
    "split": ("q", "select entity_id s1_id, case when row_number() over (order by md5('42:' || entity_id), entity_id) <= round_even((select count(*) from q) * 0.2::double, 0) then 'validation' else 'train' end split from q"),
    "held": ("truth split", "select distinct match_id from truth join split using (s1_id) where split = 'validation' and match_id not in (select match_id from truth join split using (s1_id) where split = 'train')"),
    "fdocs": ("p held", "select country, count(*) n from p where entity_id not in (select match_id from held) group by country"),
    "fterms": ("toks held", "select field, country, term, count(*) df from toks where src > 1 and field <> 'grams' and entity_id not in (select match_id from held) group by all"),
}


def _weights(docs: str, terms: str) -> str:
    return f"select entity_id, t.country, field, term, 1 + ln((coalesce(n, 0) + 1)::double / (coalesce(df, 0) + 1)) w, coalesce(df, 0) >= 0.01::double * greatest(1, coalesce(n, 0)) common from toks t left join {terms} using (field, country, term) left join {docs} d on d.country = t.country where field <> 'grams'"


for _p, _d, _t in (("", "docs", "terms"), ("f", "fdocs", "fterms")):
    PARTS |= {
        f"{_p}wt": (f"toks {_d} {_t}", _weights(_d, _t)),
        f"{_p}tot": (f"{_p}wt", f"select entity_id, sum(w) filter (where field = 'name') n_tot, sum(w) filter (where field = 'address') a_tot from {_p}wt group by 1"),
        f"{_p}mass": (f"{_p}wt ex", rf"""select s1_id, cand_id, sum(a.w) filter (where field = 'name') n_mass, sum(a.w) filter (where field = 'address') a_mass, sum(least(a.w, b.w)) filter (where field = 'name') n_least, sum(least(a.w, b.w)) filter (where field = 'address') a_least,
          count(*) filter (where field = 'address' and not regexp_full_match(term, '\p{{Nd}}+')) words, bool_or(field = 'address' and not regexp_full_match(term, '\p{{Nd}}+') and not a.common) distinctive, max(a.w) filter (where field = 'address' and regexp_full_match(term, '\p{{Nd}}+')) num
          from ex join {_p}wt a on a.entity_id = s1_id join {_p}wt b on b.entity_id = cand_id and b.field = a.field and b.term = a.term group by all""".replace("from ex join", "from ex e join").replace("where field", "where a.field").replace("(field =", "(a.field =").replace("(term,", "(a.term,")),
        f"{_p}sig": (f"ex {_p}mass {_p}tot q p {_d}", f"""select *, greatest(exact_, 0.65::double * nd + 0.35::double * gd) ne, case when words >= 2 and distinctive then 0.65::double * ad + 0.35::double * ct else ad end ae, coalesce(num / (1 + ln(coalesce(n, 0) + 1)), 0)::double qe from (
          select ex.*, a.country, words, distinctive, num, n, (a.name <> '' and a.name = b.name)::int::double exact_,
          case when coalesce(x.n_tot, 0) + coalesce(y.n_tot, 0) > 0 then 2 * coalesce(n_mass, 0) / (coalesce(x.n_tot, 0) + coalesce(y.n_tot, 0)) else 0 end nd,
          case when len(a.bi) + len(b.bi) > 0 then 2.0::double * len(list_intersect(a.bi, b.bi)) / (len(a.bi) + len(b.bi)) else 0 end gd,
          case when coalesce(x.a_tot, 0) + coalesce(y.a_tot, 0) > 0 then 2 * coalesce(a_mass, 0) / (coalesce(x.a_tot, 0) + coalesce(y.a_tot, 0)) else 0 end ad,
          case when least(coalesce(x.a_tot, 0), coalesce(y.a_tot, 0)) > 0 then coalesce(a_mass, 0) / least(x.a_tot, y.a_tot) else 0 end ct
          from ex join q a on a.entity_id = s1_id join p b on b.entity_id = cand_id left join {_p}tot x on x.entity_id = s1_id left join {_p}tot y on y.entity_id = cand_id left join {_p}mass using (s1_id, cand_id) left join {_d} d on d.country = a.country where a.country = b.country and a.country <> '')"""),
        f"{_p}sc": (f"{_p}sig", f"select *, round_even(0.65::double * ne + 0.30::double * ae + 0.05::double * qe, 12) weighted, round_even(greatest(0.65::double * ne + 0.30::double * ae + 0.05::double * qe, 0.85::double * ae + 0.10::double * ne + 0.05::double * qe), 12) score from {_p}sig"),
    }


def _jac(a: str, b: str) -> str:
    return f"(case when len({a}) + len({b}) > 0 then len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) else 0 end)"


def _dice(a: str, b: str) -> str:
    return f"(case when len({a}) + len({b}) > 0 then 2.0::double * len(list_intersect({a}, {b})) / (len({a}) + len({b})) else 0 end)"


def _indel(a: str, b: str) -> str:
    """The indel ratio: rows of the table of longest common subsequences, one for each character of ``b``."""
    letters = lambda s: f"list_transform(range(1, length({s}) + 1), lambda i: substr({s}, i, 1))"
    equal = f"list_transform({letters(b)}, lambda y: list_transform({letters(a)}, lambda x: (x = y)::int))"
    step = "list_transform(range(1, len(e) + 1), lambda k: list_max(list_transform(range(1, k + 1), lambda j: greatest(acc[j], (case when j > 1 then acc[j - 1] else 0 end) + e[j]))))"
    rows = f"list_reduce(list_prepend(list_transform({letters(a)}, lambda x: 0), {equal}), lambda acc, e: {step})"
    return f"(case when length({a}) > 0 and length({b}) > 0 then 2.0::double * list_last({rows}) / (length({a}) + length({b})) else 0 end)"


def _prefix(a: str, b: str) -> str:
    return "(case " + " ".join(f"when length({a}) >= {k} and length({b}) >= {k} and substr({a}, 1, {k}) = substr({b}, 1, {k}) then {k}" for k in (4, 3, 2, 1)) + " else 0 end / 4.0::double)"


def _ratio(a: str, b: str) -> str:
    return f"(case when greatest(length({a}), length({b})) > 0 then least(length({a}), length({b}))::double / greatest(length({a}), length({b})) else 0 end)"


_supported = " + ".join(f"{s} * {w}::double" for s, w in zip(SIGNALS, FORMULAS["address_supported"]))
PARTS |= {
    "psig": ("c q p", f"""select s1_id, cand_id, (a.name <> '' and a.name = b.name)::int::double name_exact, {_jac('a.ns', 'b.ns')} name_jaccard, {_dice('a.bi', 'b.bi')} name_bigram_dice, {_prefix('a.name', 'b.name')} name_prefix,
      {_jac('a.ads', 'b.ads')} address_jaccard, list_has_any(a.nums, b.nums)::int::double shared_number, (a.country <> '' and a.country = b.country) country_equal, (a.address = '' or b.address = '') missing_address from c join q a on a.entity_id = s1_id join p b on b.entity_id = cand_id"""),
    "fr": ("psig", " union all ".join(f"select '{f}' formula, s1_id, cand_id, round_even({' + '.join(f'{s} * {x}::double' for s, x in zip(SIGNALS, w))}, 12) score from psig where country_equal" for f, w in FORMULAS.items())),
    "ranks": ("fr", "select *, row_number() over (partition by formula, s1_id order by score desc, cand_id) as rank from fr"),
    "sup": ("ranks", "select s1_id, cand_id, score, rank from ranks where formula = 'address_supported'"),
    "vr": ("sc", """select *, row_number() over (partition by variant, s1_id order by score desc, cand_id) as rank from (
      select 'C_weighted' variant, s1_id, cand_id, weighted score from sc where in_c union all select 'C_address_rescue', s1_id, cand_id, score from sc where in_c union all select 'expanded_address_rescue', s1_id, cand_id, score from sc)"""),
    "fails": ("truth sup", f"select s1_id, match_id, rank, case when rank is null then 'blocking' else 'ranking' end kind from truth left join sup on truth.s1_id = sup.s1_id and match_id = cand_id where rank is null or rank > {CUTOFF}".replace("select s1_id,", "select truth.s1_id,")),
    "common": ("terms docs", "select field, country, term from terms join docs using (country) where field <> 'grams' and df >= 0.01::double * n"),
    "lists": ("q truth", "select entity_id s1_id, count(match_id) n, count(*) filter (where match_id like 'S2-%') s2, count(*) filter (where match_id like 'S3-%') s3 from q left join truth on s1_id = entity_id group by 1"),
    "feat": ("fsc ftot fmass q p truth split", f"""select r.s1_id, r.cand_id, (a.name <> '' and a.name = b.name)::int name_exact, round_even({_jac('a.ns', 'b.ns')}, 8) name_token_jaccard, round_even({_dice('a.bi', 'b.bi')}, 8) name_bigram_dice, round_even({_dice('a.tri', 'b.tri')}, 8) name_trigram_dice,
      round_even({_ratio('a.name', 'b.name')}, 8) name_length_ratio, {_prefix('a.name', 'b.name')} name_prefix_similarity, round_even(case when coalesce(x.n_tot, 0) + coalesce(y.n_tot, 0) > 0 then 2 * coalesce(n_least, 0) / (coalesce(x.n_tot, 0) + coalesce(y.n_tot, 0)) else 0 end, 8) name_rare_token_dice,
      (a.name = '')::int s1_name_missing, (b.name = '')::int candidate_name_missing, (a.address <> '' and a.address = b.address)::int address_exact, round_even({_jac('a.ads', 'b.ads')}, 8) address_token_jaccard, round_even({_dice('a.abi', 'b.abi')}, 8) address_bigram_dice,
      len(list_intersect(a.nums, b.nums))::int shared_numeric_token_count, round_even({_jac('a.nums', 'b.nums')}, 8) numeric_token_jaccard, round_even(case when coalesce(x.a_tot, 0) + coalesce(y.a_tot, 0) > 0 then 2 * coalesce(a_least, 0) / (coalesce(x.a_tot, 0) + coalesce(y.a_tot, 0)) else 0 end, 8) address_rare_token_dice,
      (a.address = '')::int s1_address_missing, (b.address = '')::int candidate_address_missing, (a.address = '' and b.address = '')::int both_addresses_missing, round_even({_ratio('a.address', 'b.address')}, 8) address_length_ratio, (a.country <> '' and a.country = b.country)::int country_equal,
      (b.src = 2)::int candidate_is_s2, (b.src = 3)::int candidate_is_s3, round_even(r.score, 8) candidate_ranking_score, r.rank::int candidate_rank, 1 ranking_available, (t.match_id is not null)::int as label, split
      from (select *, row_number() over (partition by s1_id order by score desc, cand_id) as rank from fsc) r join q a on a.entity_id = r.s1_id join p b on b.entity_id = r.cand_id left join ftot x on x.entity_id = r.s1_id left join ftot y on y.entity_id = r.cand_id
      left join fmass m on m.s1_id = r.s1_id and m.cand_id = r.cand_id left join truth t on t.s1_id = r.s1_id and t.match_id = r.cand_id join split s on s.s1_id = r.s1_id where r.rank <= 50"""),
}
PARTS |= {
    "long": ("feat", " union all ".join(f"select split, label, '{f}' feature, round_even({f}::double, 8) as v from feat" for f in FEATURES)),
    "stats": ("long", "select split, label, feature, count(*) as count, avg(v) as mean, stddev_pop(v) as std, min(v) as min, " + ", ".join(f"quantile_cont(v, {x}) as {p}" for p, x in PERCENTILES.items()) + ", max(v) as max from long group by all"),
}


def sql(needs: str, body: str) -> str:
    """``body`` after the named parts that it needs, each once and after those that it builds on."""
    order: list[str] = []

    def add(names: str) -> None:
        for n in names.split():
            if n not in order:
                add(PARTS[n][0])
                order.append(n)

    add(needs)
    materialized = {"full", "toks", "terms", "ex", "c", "psig", "sc", "fsc", "wt", "fwt", "mass", "fmass", "feat", "truth"}
    name = lambda n: "full_" if n == "full" else n
    return "with " + ",\n".join(f"{name(n)} as {'materialized ' if n in materialized else ''}({PARTS[n][1]})" for n in order) + "\n" + body


def _counts(n: str = "n") -> str:
    return f"{_r(f'avg({n})', 'average_candidates')}, {_r(f'median({n})::double', 'median_candidates')}, max({n})::bigint maximum_candidates, {_r(f'100.0::double * count(*) filter (where {n} = 0) / count(*)', 'zero_candidate_percent')}, sum({n})::bigint total_pairs"


def _links(flag: str) -> str:
    out = f"count(*) true_links, count(*) filter (where {flag}) found_links, "
    return out + ", ".join(f"count(*) filter (where match_id like '{s}-%') {s}_links, count(*) filter (where match_id like '{s}-%' and {flag}) {s}_found" for s in ("S2", "S3"))


_recalls = ", ".join(_r(f"{a}::double / nullif({b}, 0)", c) for a, b, c in (("found_links", "true_links", "overall_recall"), ("S2_found", "S2_links", "S2_recall"), ("S3_found", "S3_links", "S3_recall")))
_link_columns = "true_links, found_links, S2_links, S2_found, S3_links, S3_found"


def _evaluate(axis: str, there: str) -> str:
    """``there``: a part's rows (axis, s1_id, cand_id)."""
    return f""", there as (select distinct * from ({there})), names as (select distinct {axis} from there),
    n as (select q.entity_id s1_id, names.{axis}, count(cand_id) n from q cross join names left join there on there.s1_id = q.entity_id and there.{axis} = names.{axis} group by all),
    cs as (select {axis}, {_counts()} from n group by 1), ls as (select names.{axis}, {_links('there.cand_id is not null')} from truth cross join names left join there on there.s1_id = truth.s1_id and there.cand_id = match_id and there.{axis} = names.{axis} group by 1)
    select cs.*, {_link_columns}, {_recalls} from cs join ls using ({axis})"""


_abc = "select 'A' as config, s1_id, cand_id from hits where rule = 'name_token' union all select 'B', s1_id, cand_id from hits where rule <> 'name_prefix' union all select 'C', s1_id, cand_id from hits"


def _sweep(axis: str, ranks: str, ks: tuple[int, ...]) -> str:
    return f""", names as (select distinct {axis} from {ranks}), ks as (select unnest([{', '.join(map(str, ks))}])::int k),
    sz as (select q.entity_id s1_id, names.{axis}, count(cand_id) al from q cross join names left join {ranks} r on r.s1_id = q.entity_id and r.{axis} = names.{axis} group by all),
    cs as (select {axis}, k, {_counts('least(k, al)')} from sz cross join ks group by 1, 2),
    lr as (select names.{axis}, truth.match_id, rank from truth cross join names left join {ranks} r on r.s1_id = truth.s1_id and r.cand_id = match_id and r.{axis} = names.{axis}),
    ls as (select {axis}, k, {_links('rank <= k')} from lr cross join ks group by 1, 2), br as (select {axis}, count(rank) broad_found, count(rank) filter (where match_id like 'S2-%') broad_S2, count(rank) filter (where match_id like 'S3-%') broad_S3 from lr group by 1),
    sweep as (select cs.*, {_link_columns}, {_recalls}, broad_found, broad_S2, broad_S3, broad_found - found_links lost_links, true_links - found_links missed_links, broad_S2 - S2_found S2_lost, broad_S3 - S3_found S3_lost from cs join ls using ({axis}, k) join br using ({axis}))
    """


_summary = "count(*) links, median(rank)::double median_rank, quantile_disc(rank, 0.9) p90, quantile_disc(rank, 0.95) p95, quantile_disc(rank, 0.99) p99, max(rank) maximum_rank"
_gram_dice = _dice("a.bi", "b.bi")
_simple_flags = {
    "country_missing_or_different": "not (a.country <> '' and a.country = b.country)",
    "first_name_token_changed": "len(a.nt) > 0 and len(b.nt) > 0 and a.nt[1] <> b.nt[1]",
    "name_tokens_reordered": "len(a.nt) > 0 and len(b.nt) > 0 and a.nt <> b.nt and list_sort(a.ns) = list_sort(b.ns)",
    "no_shared_name_tokens": "not list_has_any(a.ns, b.ns)",
    "abbreviation_proxy": "len(list_filter(a.ns, lambda x: len(list_filter(b.ns, lambda y: (length(x) >= 2 and length(y) > length(x) and starts_with(y, x)) or (length(y) >= 2 and length(x) > length(y) and starts_with(x, y)))) > 0)) > 0",
    "address_missing": "a.address = '' or b.address = ''",
    "nonempty_addresses_differ": "a.address <> '' and b.address <> '' and a.address <> b.address",
    "no_shared_address_words": "not list_has_any(a.wds, b.wds)",
    "address_numbers_disjoint": "len(a.nums) > 0 and len(b.nums) > 0 and not list_has_any(a.nums, b.nums)",
    "address_numbers_missing_on_either_side": "len(a.nums) = 0 or len(b.nums) = 0",
    "short_name_on_either_side": "len(a.nt) <= 2 or len(b.nt) <= 2",
    "all_name_tokens_common_on_either_side": "(len(a.ns) > 0 and len(list_intersect(a.ns, coalesce(ct, []))) = len(a.ns)) or (len(b.ns) > 0 and len(list_intersect(b.ns, coalesce(ct, []))) = len(b.ns))",
    "weak_character_name_overlap": f"{_gram_dice} < 0.2",
    "different_dominant_scripts": "coalesce(pa.dominant <> pb.dominant, false)",
    "disjoint_letter_scripts": "len(pa.scripts) > 0 and len(pb.scripts) > 0 and not list_has_any(pa.scripts, pb.scripts)",
    "spelling_change_proxy": f"pa.dominant is not distinct from pb.dominant and a.name <> b.name and {_gram_dice} >= 0.5",
}


def _script_ranges() -> str:
    """(lo, hi, script) of the runs of letters of one script."""
    table, names = script_table()
    first = np.flatnonzero(np.diff(table, prepend=-2))
    last = np.append(first[1:], len(table)) - 1
    return ", ".join(f"({a}, {b}, '{names[table[a]]}')" for a, b in zip(first.tolist(), last.tolist()) if table[a] >= 0)


_flag_rows = "from fails f join q a on a.entity_id = f.s1_id join p b on b.entity_id = match_id left join ctn on ctn.country = a.country join prof pa on pa.entity_id = a.entity_id join prof pb on pb.entity_id = b.entity_id"
PARTS |= {
    "ctn": ("common", "select country, list(term) ct from common where field = 'name' group by 1"),
    "sr": ("", f"select * from (values {_script_ranges()}) t(lo, hi, script)"),
    "letters": ("full sr", "select entity_id, script, count(*) n from (select entity_id, unicode(unnest(list_transform(range(1, length(name) + 1), lambda i: substr(name, i, 1)))) point from full_) x join sr on point between lo and hi group by 1, 2"),
    "prof": ("full letters", "select full_.entity_id, coalesce(scripts, []) scripts, dominant from full_ left join (select entity_id, list(script order by script) scripts, list(script order by n desc, script)[1] dominant from letters group by 1) x using (entity_id)"),
    "flagged": ("fails q p ctn prof", " union all ".join(f"select kind, '{f}' flag, a.seq, f.s1_id, match_id cand_id {_flag_rows} where {x}" for f, x in _simple_flags.items())),
    "best_false": ("sup truth", f"select s1_id, min_by(cand_id, rank) rival_id, min(rank) rival_rank from sup where rank <= {CUTOFF} and not exists (select 1 from truth t where t.s1_id = sup.s1_id and t.match_id = sup.cand_id) group by 1"),
    "pooled": ("p truth", "select entity_id from p where src = 2 and entity_id in (select match_id from truth) union all (select entity_id from p where src = 2 and entity_id not in (select match_id from truth) order by md5('44:' || entity_id), entity_id limit 100)"),
}


_sql_lines = RESULT_LINES.replace("{documents}", "documents").replace("\t", "' || chr(9) || '")
PARTS |= {
    "lines": ("", _sql_lines),
    "vl": ("lines", "select line, case when instr(value, chr(9)) = 0 then value else substr(value, 1, instr(value, chr(9)) - 1) end s1_id, case when instr(value, chr(9)) = 0 or trim(substr(value, instr(value, chr(9)) + 1)) = '' then []::varchar[] else string_split(substr(value, instr(value, chr(9)) + 1), ',') end ids, instr(value, chr(9)) = 0 malformed from lines where line > 1 and (trim(value) <> '' or instr(value, chr(9)) > 0)"),
    "vg": ("vl", "select * from vl where not malformed"),
    "vlast": ("vg", "select s1_id, max_by(ids, line) ids from vg group by 1"),
    "veach": ("vg", "select distinct id from (select unnest(ids) id from vg)"),
    "vf": ("vl vg vlast veach q p", """select 'malformed_row' as rule, line::varchar who from vl where malformed union all select 'duplicate_entity', s1_id from vg group by s1_id having count(*) > 1
      union all select distinct 'repeated_id', s1_id from vg where len(ids) <> len(list_distinct(ids)) union all select 'self_match', id from veach where id like 'S1-%'
      union all select 'wrong_prefix', id from veach where id not like 'S1-%' and id not like 'S2-%' and id not like 'S3-%' union all select 'missing_entity', entity_id from q where entity_id not in (select s1_id from vlast)
      union all select 'extra_entity', s1_id from vlast where s1_id not in (select entity_id from q) union all select 'unknown_id', id from veach where (id like 'S2-%' or id like 'S3-%') and id not in (select entity_id from p)"""),
}

_formula_ranks = lambda f: sql("ranks", f"select s1_id, cand_id, {_r('score', 'score')}, rank from ranks where formula = '{f}'")
_stat_columns = ", ".join(_r(c, c) for c in ("mean", "std", "min", *PERCENTILES, "max"))
_separation = """pn as (select a.feature, a.mean positive_mean, b.mean negative_mean, a.std ps, b.std ns_ from stats a join stats b on a.feature = b.feature and a.split = 'train' and b.split = 'train' and a.label = 1 and b.label = 0)
select feature, {pm}, {nm}, {gap}, case when positive_mean > negative_mean then 'higher' when positive_mean < negative_mean then 'lower' else 'none' end positive_direction from pn""".format(
    pm=_r("positive_mean", "positive_mean"), nm=_r("negative_mean", "negative_mean"), gap=_r("abs(positive_mean - negative_mean) / greatest(sqrt((ps * ps + ns_ * ns_) / 2), 1e-12::double)", "standardized_mean_gap")
)

_DRIFT = {f"{c}_{m}": of.format(f"coalesce(trim(business_{c}), '')") for c in ("name", "address") for m, of in (("length", "avg(length(nullif({}, '')))"), ("missing", "100.0::double * count(*) filter (where {} = '') / count(*)"))}


def _drift(side: str) -> str:
    return ", ".join(f"{of} {side}_{m}" for m, of in _DRIFT.items())


ORACLES: dict[str, str] = {
    "normalize_records": sql("rec", "select entity_id, name, address, country, src, seq from rec"),
    "blocking_keys": sql("keys", "select * from keys"),
    "candidates_a": sql("hits", "select distinct s1_id, cand_id from hits where rule = 'name_token'"),
    "candidates_b": sql("hits", "select distinct s1_id, cand_id from hits where rule <> 'name_prefix'"),
    "candidates_c": sql("c", "select * from c"),
    "block_eval_abc": sql("hits q truth", "") + _evaluate("config", _abc),
    "doc_freq": sql("terms", "select field, country, term, df from terms"),
    "idf_weights": sql("terms docs", f"select field, country, term, {_r('1 + ln((n + 1)::double / (df + 1))', 'idf')} from terms join docs using (country)"),
    "rare_name_tokens": sql("rn", "select * from rn"),
    "rare_address_tokens": sql("ra", "select * from ra"),
    "rare_trigrams": sql("rt", "select * from rt"),
    "expanded_candidates": sql("ex", "select * from ex"),
    "pair_signals": sql("psig", f"select s1_id, cand_id, {', '.join(_r(s, s) for s in SIGNALS)}, country_equal, missing_address from psig"),
    **{f"rank_{f}": _formula_ranks(f) for f in FORMULAS},
    "topk_sweep": sql("ranks q truth", "") + _sweep("formula", "ranks", (20, 30, 50, 75, 100, 150)) + "select * from sweep",
    "formula_selection": sql("ranks q truth", "") + _sweep("formula", "ranks", (20, 30, 50, 75, 100, 150)) + """, best as (select formula from sweep group by 1 order by max(overall_recall) filter (where k = 50) desc, max(overall_recall) filter (where k = 20) desc, case formula when 'name_first' then 0 when 'balanced' then 1 else 2 end limit 1)
      select formula, coalesce(min(k) filter (where lost_links::double / true_links <= 0.005), max(k)) k, bool_or(lost_links::double / true_links <= 0.005) k_loss_target_met from sweep join best using (formula) group by 1""",
    "rank_summary": sql("ranks truth", f"select formula, unnest(['overall', split_part(match_id, '-', 1)]) as scope, {_summary} from ranks join truth on truth.s1_id = ranks.s1_id and match_id = cand_id group by 1, 2").replace(f"select formula, unnest(['overall', split_part(match_id, '-', 1)]) as scope, {_summary} from", f"select formula, scope, {_summary} from (select formula, rank, unnest(['overall', split_part(match_id, '-', 1)]) as scope from").replace("match_id = cand_id group by 1, 2", "match_id = cand_id) group by 1, 2"),
    "improved_signals": sql("sc", f"select s1_id, cand_id, {_r('ne', 'name_evidence')}, {_r('ae', 'address_evidence')}, {_r('qe', 'numeric_evidence')}, {_r('weighted', 'weighted')}, {_r('score', 'score')} from sc"),
    "address_rescue_top50": sql("vr", f"select s1_id, cand_id, {_r('score', 'score')}, rank from vr where variant = 'expanded_address_rescue' and rank <= 50"),
    "expansion_eval": sql("ex q truth", "") + _evaluate("variant", "select 'C' as variant, s1_id, cand_id from ex where in_c union all select 'C_tokens', s1_id, cand_id from ex where in_c or in_tokens union all select 'C_tokens_ngrams', s1_id, cand_id from ex"),
    "experiment_sweep": sql("vr q truth", "") + _sweep("variant", "vr", (50, 100, 150, 200)) + "select * from sweep",
    "experiment_ranks": sql("vr truth", f"select variant, {_summary} from vr join truth on truth.s1_id = vr.s1_id and match_id = cand_id group by 1"),
    "recovery_accounting": sql("vr fails", "select k, kind, count(*) filter (where v.rank <= k) recovered from fails f left join vr v on variant = 'expanded_address_rescue' and v.s1_id = f.s1_id and v.cand_id = f.match_id cross join (select unnest([50, 100, 150, 200])::int k) group by all"),
    "newly_lost_links": sql("vr fails truth", f"select count(*) newly_lost from truth t left join vr v on variant = 'expanded_address_rescue' and v.s1_id = t.s1_id and v.cand_id = t.match_id where (v.rank is null or v.rank > {CUTOFF}) and not exists (select 1 from fails f where f.s1_id = t.s1_id and f.match_id = t.match_id)"),
    "pair_features": sql("feat", f"select s1_id, cand_id, {", ".join(FEATURES)}, label, split from feat"),
    "feature_statistics": sql("stats", f"select split, label, feature, count, {_stat_columns} from stats"),
    "separation_report": sql("stats", "") + ", " + _separation,
    "constant_features": sql("stats", "select feature from stats where split = 'train' group by 1 having min(min) = max(max)"),
    "split_entities": sql("split", "select s1_id, split from split"),
    "label_balance": sql("feat split truth", f"""select split, s1_entities, zero_candidate_entities, positive_pairs, candidate_pairs - positive_pairs negative_pairs, candidate_pairs, {_r('coalesce(100.0::double * positive_pairs / nullif(candidate_pairs, 0), 0)', 'positive_percentage')},
      {_r('coalesce(100.0::double * (candidate_pairs - positive_pairs) / nullif(candidate_pairs, 0), 0)', 'negative_percentage')}, {_r('(candidate_pairs - positive_pairs)::double / nullif(positive_pairs, 0)', 'negative_positive_ratio')}, known_true_links, {_r('positive_pairs::double / nullif(known_true_links, 0)', 'candidate_recall')}, {_r('candidate_pairs::double / s1_entities', 'mean_candidates_per_s1')}
      from (select split, count(*) s1_entities, count(*) filter (where n is null) zero_candidate_entities, coalesce(sum(p), 0)::bigint positive_pairs, coalesce(sum(n), 0)::bigint candidate_pairs from split left join (select s1_id, count(*) n, sum(label) p from feat group by 1) using (s1_id) group by 1)
      join (select split, count(*) known_true_links from split join truth using (s1_id) group by 1) using (split)"""),
    "frozen_doc_freq": sql("fterms", "select field, country, term, df from fterms"),
    "failure_kinds": sql("fails", "select s1_id, match_id, rank, kind from fails"),
    "failure_flags": sql("fails q p ctn prof", f"select f.s1_id, match_id cand_id, kind, {', '.join(f'coalesce({x}, false) {f}' for f, x in _simple_flags.items())} {_flag_rows}"),
    "script_profiles": sql("q prof", "select entity_id, array_to_string(scripts, ',') scripts, dominant from q join prof using (entity_id)"),
    "fuzz_ratio": sql("truth q p", f"""select s1_id, match_id cand_id, {_r(_indel('m', 'n'), 'name_indel_ratio')}, {_r("case when len(x) = 0 or len(y) = 0 then 0 when len(list_intersect(x, y)) > 0 and (len(list_intersect(x, y)) = len(x) or len(list_intersect(x, y)) = len(y)) then 1 else greatest(" + ", ".join(_indel(s, t) for s, t in (("l", "r"), ("c", "l"), ("c", "r"))) + ") end", 'name_token_set_ratio')}
      from (select *, trim(c || ' ' || array_to_string(list_sort(list_filter(x, lambda t: not list_contains(y, t))), ' ')) l, trim(c || ' ' || array_to_string(list_sort(list_filter(y, lambda t: not list_contains(x, t))), ' ')) r from (select *, array_to_string(list_sort(list_intersect(x, y)), ' ') c from
        (select s1_id, match_id, a.ns x, b.ns y, a.name m, b.name n from truth join q a on a.entity_id = s1_id join p b on b.entity_id = match_id))) z"""),
    "failure_categories": sql("flagged", "select kind, flag, count(*) links from flagged group by 1, 2"),
    "failure_examples": sql("flagged", "select kind, flag, s1_id, cand_id, place from (select *, row_number() over (partition by kind, flag order by seq, cand_id) place from flagged) where place <= 2"),
    "rival_diagnostics": sql("best_false fails q p psig common", """select f.s1_id, f.match_id, rival_id, len(list_intersect(a.ns, b.ns)) > 0 and not exists (select 1 from (select unnest(list_intersect(a.ns, b.ns)) x) where x not in (select term from common where field = 'name' and country = a.country)) shares_only_common_name_tokens,
      exists (select 1 from (select unnest(list_intersect(a.nums, b.nums)) x) where x in (select term from common where field = 'address' and country = a.country)) shares_a_common_number, r.address_jaccard < t.address_jaccard less_address_overlap_than_true, r.name_bigram_dice > t.name_bigram_dice more_name_bigram_overlap
      from fails f join best_false using (s1_id) join q a on a.entity_id = f.s1_id join p b on b.entity_id = rival_id join psig r on r.s1_id = f.s1_id and r.cand_id = rival_id join psig t on t.s1_id = f.s1_id and t.cand_id = f.match_id where kind = 'ranking'"""),
    "failure_cutoffs": sql("fails sup truth", f"select s1_id, cand_id cutoff_id, {_r('score', 'cutoff_score')}, exists (select 1 from truth t where t.s1_id = sup.s1_id and t.match_id = sup.cand_id) is_true from sup where rank = {CUTOFF} and s1_id in (select s1_id from fails where kind = 'ranking')"),
    "ranking_examples": sql("sup truth q", f"""select outcome, s1_id from (select *, row_number() over (partition by outcome order by seq, s1_id) k from (select unnest(case when outside = 0 and al > {CUTOFF} then ['success'] when beyond > 0 then ['failure'] else [] end) outcome, s1_id, seq from
      (select t.s1_id, count(*) filter (where rank is null or rank > {CUTOFF}) outside, count(*) filter (where rank > {CUTOFF}) beyond from truth t left join sup on sup.s1_id = t.s1_id and cand_id = match_id group by 1) join (select s1_id, count(*) al from sup group by 1) using (s1_id) join q on entity_id = s1_id)) where k <= 10"""),
    "candidate_listing": sql("c truth q", """, f as (select entity_id s1_id from q order by seq, entity_id limit 10) select coalesce(c.s1_id, t.s1_id) s1_id, coalesce(c.cand_id, t.match_id) cand_id, t.s1_id is not null is_match, c.s1_id is not null is_candidate
      from c full join truth t on t.s1_id = c.s1_id and t.match_id = c.cand_id where coalesce(c.s1_id, t.s1_id) in (select s1_id from f)"""),
    "truth_cardinality": sql("lists", "select count(*) entities, " + ", ".join(f"count(*) filter (where {x}) matches_{k}, {_r(f'100.0::double * count(*) filter (where {x}) / count(*)', f'percent_{k}')}" for k, x in (("zero", "n = 0"), ("one", "n = 1"), ("two", "n = 2"), ("three_or_more", "n >= 3"))) + f", max(n) most_matches, {_r('avg(n)', 'average_matches')}, sum(n)::bigint total_links from lists"),
    "source_coverage": sql("lists", "select sum(s2)::bigint s2_links, sum(s3)::bigint s3_links, count(*) filter (where s2 > 0 and s3 = 0) only_s2, count(*) filter (where s3 > 0 and s2 = 0) only_s3, count(*) filter (where s2 > 0 and s3 > 0) both_sources, count(*) filter (where s2 = 0 and s3 = 0) no_links from lists"),
    "integrity_checks": sql("truth p q", """, l as (select s1_id, list(match_id) ids, substr(s1_id, 4)::bigint k from truth group by 1), f as (select case when k % 11 = 0 then 'S1-x' || k else s1_id end s1_id, case when k % 7 = 0 then list_append(ids, ids[1]) when k % 7 = 1 then list_append(ids, 'S2-x' || s1_id) when k % 7 = 2 then list_append(ids, 'Q-1') else ids end ids from l),
      e as (select s1_id, unnest(ids) id from f) select (select count(*) from f where s1_id not in (select entity_id from q)) unknown_entities, (select count(*) from e where id not in (select entity_id from p) and id like 'S2-%') unknown_s2, (select count(*) from e where id not in (select entity_id from p) and id like 'S3-%') unknown_s3,
      (select count(*) from e where id not in (select entity_id from p) and id not like 'S2-%' and id not like 'S3-%') unknown_prefix, (select count(*) from f where len(ids) <> len(list_distinct(ids))) lists_with_repeats"""),
    "orders_customer_integrity": "select count(*) orders_without_customer from orders where not exists (select 1 from customer where c_custkey = o_custkey)",
    "customer_profile": "select count(*) row_count, 5::bigint column_count, " + ", ".join(f"count(*) filter (where coalesce({c}::varchar, '') = '' or lower({c}::varchar) = 'nan') {c}_missing" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")) + ", count(distinct c_custkey) unique_ids, count(*) - count(distinct c_custkey) duplicate_ids from customer",
    "text_stats": sql("rec", f", s as (select src, nullif(trim(business_address), '') x from rec) select src, count(*) row_count, {_r('100.0::double * count(*) filter (where x is null) / count(*)', 'missing_percent')}, {_r('avg(length(x))', 'mean_length')}, {_r('median(length(x))::double', 'median_length')}, count(distinct x) unique_values, count(x) - count(distinct x) exact_duplicates from s group by 1"),
    "value_counts": sql("rec", "select src, country, count(*) row_count from rec group by 1, 2"),
    "train_test_drift": sql("rec", f""", a as (select * from rec where (seq // 10) % 2 = 0), z as (select * from rec where (seq // 10) % 2 = 1)
      select src, train_rows, test_rows, {", ".join(_r(f"{p}_{m}", f"{p}_{m}") for p in ("train", "test") for m in _DRIFT)}, len(train_c)::bigint train_country_count, len(test_c)::bigint test_country_count, array_to_string(list_sort(list_filter(test_c, lambda x: not list_contains(train_c, x))), ',') unseen_countries from
      (select src, count(*) train_rows, {_drift("train")}, list(distinct country) train_c from a group by 1) join (select src, count(*) test_rows, {_drift("test")}, list(distinct country) test_c from z group by 1) using (src)"""),
    "record_examples": sql("lists q p truth", """, k as (select *, row_number() over (partition by kind order by seq, s1_id) place from (select case when n = 0 then 'none' when n = 1 then 'one' else 'two' end kind, s1_id, business_name s1_name, seq from lists join q on entity_id = s1_id))
      select p.entity_id match_id, k.s1_id, kind, s1_name, p.business_name match_name from k left join truth on truth.s1_id = k.s1_id left join p on p.entity_id = match_id where place <= case kind when 'two' then 3 else 10 end"""),
    "validator_findings": sql("vf", ", o as (select *, row_number() over (partition by rule order by who) k from vf) select rule, count(*) offenders, string_agg(who, ', ' order by who) filter (where k <= 5) as first from o group by 1"),
    "pool_sample": sql("pooled", "select entity_id from pooled"),
    "pool_sample_stats": sql("pooled p truth", "select (select count(*) from p where src = 2) scanned_rows, (select count(*) from pooled where entity_id in (select match_id from truth)) true_match_records, (select count(*) from pooled where entity_id not in (select match_id from truth)) distractors, (select count(*) from pooled) retained_rows"),
    "row_range_sample": sql("q", "select entity_id from (select entity_id, row_number() over (order by seq, entity_id) k from q) where k between 21 and 60"),
    "result_lists": sql("q truth", "select entity_id s1_id, coalesce(string_agg(match_id, ',' order by match_id), '') ids from q left join truth on s1_id = entity_id group by 1"),
}
ORACLES |= {
    "tsv_records": sql("rec", "select entity_id, name, address, country, src, seq from rec"),
    "truth_links": sql("truth", "select s1_id, match_id from truth"),
    "sample_cache": sql("q p truth", "select 'query' part, entity_id, name as value from q union all select 'pool', entity_id, address from p union all select 'truth', s1_id, match_id from truth"),
    "frequency_snapshot": sql("terms docs", "select field, country, term, df, n from terms join docs using (country)"),
    "pair_file": sql("c", "select s1_id source1_entity_id, cand_id candidate_entity_id, split_part(cand_id, '-', 1) candidate_source from c"),
    "feature_file": sql("feat", "select s1_id, cand_id, name_exact, label, split from feat"),
    "split_manifest": sql("split", "select s1_id source1_entity_id, split from split"),
    "id_list": sql("p", "select entity_id from p"),
    "failure_file": sql("fails", "select s1_id, match_id, rank, kind from fails"),
    "validator_rows": sql("vg", "select count(*) row_count, count(*) filter (where len(ids) = 0) empty_rows, count(*) filter (where len(ids) > 0) filled_rows from vg"),
    "matches_outside_candidates": sql("lines", """, n as (select row_number() over (order by line, value) line, value from lines), g as (select line, substr(value, 1, instr(value, chr(9)) - 1) s1_id, case when trim(substr(value, instr(value, chr(9)) + 1)) = '' then []::varchar[] else string_split(substr(value, instr(value, chr(9)) + 1), ',') end ids from n where line > 1 and instr(value, chr(9)) > 0),
      e as (select line, s1_id, unnest(ids) id from g) select distinct s1_id, id from e where not exists (select 1 from e c where c.line % 5 <> 0 and c.s1_id = e.s1_id and c.id = e.id)"""),
}
ORACLES["best_configuration"] = sql("hits q truth", "") + _evaluate("config", _abc).replace("select cs.*,", ", ev as (select cs.*,", 1).replace("from cs join ls using (config)", "from cs join ls using (config)) select config, total_pairs from ev order by overall_recall desc, average_candidates, config limit 1")
