"""SQL of the queries in domain_queries, on the same tables."""

from __future__ import annotations

from netsets.plans.model_sql import _COL, _MARKS, _MARKS_16, _nulls, _walk

_NUMBER = r"try_cast(nullif(regexp_extract(replace(weight_text, ',', '.'), '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?'), '') as double)"
_NAME = "nullif(upper(regexp_replace({}, '[^A-Za-z0-9]', '', 'g')), '')"
_NET = f"""ends as (select {_NAME.format('node1')} as a, {_NAME.format('node2')} as b, coalesce(weight, {_NUMBER}, 0) as w from ppi),
adj as (select src, dst, sum(w) as w from (select a as src, b as dst, w from ends union all select b, a, w from ends) where src is not null and dst is not null group by 1, 2 having sum(w) <> 0)"""
_GOOD = "{0} is not null and len({0}) = 64 and len(list_filter({0}, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter({0}, lambda x: x <> 0)) > 0"
_E = f"""first as (select name as gene, arg_min(gene_embedding, item_id) as v from gsemb_embedding where kind = 'gene' and {_GOOD.format('gene_embedding')} group by 1),
e as (select gene, gene as pos, generate_subscripts(v, 1) - 1 as k, unnest(v)::double as x from first)"""
_G = f"""model as (select name as set_id, arg_min(set_mu, item_id) as mu, arg_min(set_var, item_id) as v from gsemb_embedding where kind = 'set' and {_GOOD.format('set_mu')} and {_GOOD.format('set_var')} group by 1),
g as (select set_id, generate_subscripts(mu, 1) - 1 as k, unnest(mu)::double as mu, greatest(unnest(v)::double, 1e-8) as v from model)"""
_M = """c as (select set_id, revision, list_sort(list_distinct(list_filter(list_transform(gene_sets, lambda x: upper(trim(x))), lambda x: x is not null and x <> ''))) as l from gene_sets where set_id is not null),
cur as (select set_id, arg_max(l, revision) as l from c group by 1), m as (select set_id, unnest(l) as gene from cur)"""
_NODES = "nodes as (select node, row_number() over (order by node) as pos from (select distinct unnest([a, b]) as node from ends) where node is not null)"
_MARKED = _NODES + _MARKS[_MARKS.index(", marks as") :]
_MARKED_16 = _NODES + _MARKS_16[_MARKS_16.index(", marks as") :]
_FOLDED = f"fm as (select distinct set_id, {_NAME.format('gene')} as gene from m where {_NAME.format('gene')} is not null), seeded as (select set_id, gene from fm where gene in (select node from nodes))"
_SEEDS = "select landmark as node, rank as col, 1.0 as val from marks"
_SET_SEEDS = "select gene as node, set_id as col, 1.0 / count(*) over (partition by set_id) as val from seeded"


def _score(kind: str) -> str:
    value = "-sum((x - mu) * (x - mu) / v)"
    return f"s as (select set_id, gene, any_value(pos) as pos, {value if kind == 'neg_mahalanobis' else f'({value} - sum(ln(v))) / 2'} as score from m join e using (gene) join g using (set_id, k) group by 1, 2)"


def _concise(score: str) -> str:
    return f"with {_E}, {_G}, {_M}, {_score(score)}, c2 as (select s.*, row_number() over (partition by set_id order by round(score, 9) desc, pos) as rank from s)"


def _tested(stats: str, beyond: str, nperm: int = 100) -> str:
    weights = f"{_E}, {_G}, {_M}, st as ({stats}), {_score('loglik')}, raww as (select set_id, gene, s.pos as pos, exp((score - max(score) over (partition by set_id)) / 8) as z from s join st using (gene)), w as (select set_id, gene, pos, z / greatest(sum(z) over (partition by set_id), 1e-8) as w from raww)"
    return (
        f"with recursive {weights}, {_nulls(nperm)}, size as (select set_id, count(*)::int as n from m join st using (gene) group by 1), t0 as (select set_id, any_value(es) as es, (any_value(es) - any_value(m)) / greatest(any_value(sd), 1e-8) as z, greatest(avg(case when {beyond} then 1.0 else 0.0 end), 1.0 / {nperm}) as p from nul join es using (set_id) join mom using (set_id) group by set_id),"
        " t as (select set_id, coalesce(es, 0) as es, coalesce(z, 0) as z, coalesce(p, 1) as p from model left join t0 using (set_id)),"
        " ranked as (select *, row_number() over (order by p, set_id) as i, count(*) over () as n from t), adj_p as (select *, least(1.0, min(p * n / i) over (order by i desc rows unbounded preceding)) as q from ranked)"
        ' select a.set_id as "ID", round(es, 4) + 0.0 as "ES", round(z, 4) + 0.0 as z, round(p, 6) + 0.0 as pvalue, round(q, 6) + 0.0 as p_adjust, case when a.set_id in (select set_id from m) then coalesce(size.n, 0) end as "setSize" from adj_p a left join size using (set_id)'
    )


_WALKED = f"with {_NET}, {_COL}, {_MARKED_16}, {_walk(45, _SEEDS)}, n2 as (select node, round(coalesce(max(val), 0), 6) + 0.0 as most, round(coalesce(sum(val), 0), 6) + 0.0 as mass from nodes left join walk using (node) group by 1) select * from n2"

SQL = {
    "net_walk": _WALKED,
    "net_walk_grid": _WALKED,
    "net_random_walk": f"with {_NET}, {_COL}, {_MARKED}, {_walk(45, _SEEDS + ' where rank = 1')} select node, round(val, 6) + 0.0 as val from walk",
    "net_set_features": f"with {_NET}, {_COL}, {_MARKED}, {_M}, {_FOLDED}, {_walk(45, _SET_SEEDS)}, sets as (select distinct col from seed) select s.col as set_id, k.rank, round(coalesce(w.val, 0.0), 6) + 0.0 as val from sets s join marks k on true left join walk w on w.col = s.col and w.node = k.landmark",
    "net_fit_svd": f"with {_NET}, {_COL}, {_MARKED.replace('rank <= 4', 'rank <= 8')}, {_M}, {_FOLDED}, {_walk(45, _SEEDS)}, f as (select n.node, k.rank, coalesce(w.val, 0.0) as val from nodes n join marks k on true left join walk w on w.node = n.node and w.col = k.rank),"
    " cen as (select node, rank, val - avg(val) over (partition by rank) as x from f), mom as (select set_id, rank, count(*) as n, avg(x) as mu, greatest(coalesce(var_samp(x), 1e-8), 1e-8) as v from seeded join cen on gene = node group by 1, 2)"
    " select set_id, max(n) as n, round(sqrt(sum(mu * mu)), 5) + 0.0 as length, round(sum(v), 5) + 0.0 as spread from mom group by 1",
    "net_closest_sets": f"with {_G}, d as (select a.set_id as set_1, b.set_id as set_2, sum((a.mu - b.mu) * (a.mu - b.mu) + (sqrt(a.v) - sqrt(b.v)) * (sqrt(a.v) - sqrt(b.v))) as d from g a join g b using (k) where a.set_id <> b.set_id group by 1, 2), o as (select *, row_number() over (partition by set_1 order by round(d, 9), set_2) as rank from d) select set_1, set_2, round(d, 6) + 0.0 as distance, rank from o where rank <= 5",
    "net_mean_cosine": f"with {_E}, u as (select gene, k, x / sqrt(sum(x * x) over (partition by gene)) as x from e), n as (select count(*) as n from first), t as (select k, sum(x) as t from u group by 1) select gene, round(sum(x * t) / any_value(n), 6) + 0.0 as mean, any_value(n) as n from u join t using (k) join n on true group by 1",
    "net_concise_top_n": _concise("neg_mahalanobis") + " select set_id, gene, rank from c2 where rank <= 20",
    "net_concise_mass": _concise("loglik")
    + ", z as (select *, exp((score - max(score) over (partition by set_id)) / 8) as z from c2), y as (select *, sum(z) over (partition by set_id order by rank) as run, sum(z) over (partition by set_id) as total from z), t as (select set_id, min(rank) as k from y where run >= (0.8 - 1e-12) * total group by 1) select set_id, gene, rank from c2 join t using (set_id) where rank <= least(greatest(k, 5), 500)",
    "net_gsea": _tested("select gene, min(stat) as stat, gene as pos from gene_stats where stat is not null and gene in (select gene from first) group by gene", "abs(v - m) >= abs(es - m) - 1e-9"),
    "net_ora": _tested("select gene, min(y) as stat, gene as pos from gene_stats where y is not null and gene in (select gene from first) group by gene", "v >= es - 1e-9"),
}
