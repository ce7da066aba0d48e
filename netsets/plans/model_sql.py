"""SQL of the queries in model_queries, on the same tables."""

from __future__ import annotations

from netsets.operators.permutation import MIX_1, MIX_2, ROUND_STEP, ROUNDS, SEED_STEP

_V = "e as (select concat('P', vec_id) as gene, vec_id as pos, label, generate_subscripts(embedding, 1) - 1 as k, unnest(embedding)::double as x from embeddings)"
_G = _V + """, g as (select label::varchar as set_id, k, avg(x) as mu, greatest(coalesce(var_samp(x), 1e-8), 1e-8) as v from e group by 1, 2)"""
_SUPPLY = """raw as (select concat('P', l_partkey) as a, concat('S', l_suppkey) as b, sum(l_quantity) as w from lineitem group by 1, 2),
adj as (select a as src, b as dst, w from raw union all select b, a, w from raw)"""
_TRADE_RAW = """raw as (select c_nationkey::varchar as a, s_nationkey::varchar as b, sum(l_quantity) as w from lineitem join orders on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2 having sum(l_quantity) <> 0)"""
_TRADE = _TRADE_RAW + ", adj as (select a as src, b as dst, w from raw)"
_COL = "tr as (select src, dst, w / greatest(sum(w) over (partition by dst), 1e-12) as x from adj)"
_STATS = "st as (select concat('P', p_partkey) as gene, p_partkey as pos, p_retailprice as stat from part where p_partkey in (select vec_id from embeddings))"
_MEMBERS = "m as (select label::varchar as set_id, concat('P', vec_id) as gene, vec_id as pos from embeddings)"


def _score(kind: str) -> str:
    value = "-sum((x - mu) * (x - mu) / v)"
    return f"s as (select set_id, gene, any_value(pos) as pos, {value if kind == 'neg_mahalanobis' else f'({value} - sum(ln(v))) / 2'} as score from e join g using (k) group by 1, 2)"


_W = _G + ", " + _STATS + ", " + _MEMBERS + ", " + _score("loglik") + """, o as (select s.* from s join st using (gene)),
raww as (select set_id, gene, pos, exp((score - max(score) over (partition by set_id)) / 8) as z from o), w as (select set_id, gene, pos, z / greatest(sum(z) over (partition by set_id), 1e-8) as w from raww)"""
_W_MEMBERS = _W.replace("o as (select s.* from s join st using (gene))", "o as (select s.* from s join st using (gene) join m using (set_id, gene))")
_DEGREE = "deg as (select src as gene, sum(w) as degree from adj group by 1)"


def _hub(beta: float) -> str:
    lowered = f"select set_id, gene, pos, w.w / pow(greatest(coalesce(degree, 0), 1), {beta}) as z from w left join deg using (gene)"
    return f"select set_id, gene, pos, z / greatest(sum(z) over (partition by set_id), 1e-8) as w from ({lowered})"


def _walk(steps: int, seeds: str) -> str:
    """CTEs of so many steps from `seeds` (node, col, val), normalised at the end."""
    out = [f"seed as ({seeds})", "p0 as (select * from seed)"]
    for t in range(steps):
        out.append(f"p{t + 1} as materialized (select node, col, sum(val) as val from (select src as node, col, 0.5 * x * val as val from tr join p{t} on dst = node union all select node, col, 0.5 * val from seed) group by 1, 2)")
    return ", ".join([*out, f"walk as (select node, col, val / sum(val) over (partition by col) as val from p{steps})"])


_REGION_SEEDS = "select gene as node, set_id as col, 1.0 / count(*) over (partition by set_id) as val from (select n_nationkey::varchar as gene, n_regionkey::varchar as set_id from nation where n_nationkey::varchar in (select src from adj union select dst from adj))"
_NODES = "nodes as (select node, row_number() over (order by node) as pos from (select src as node from adj union select dst from adj))"
_MARKS = _NODES + ", marks as (select node as landmark, rank from (select node, row_number() over (order by coalesce(n, 0) desc, pos) as rank from nodes left join (select src, count(*) as n from adj group by 1) on src = node) where rank <= 4)"
_MARKS_16 = _MARKS.replace("rank <= 4", "rank <= 16")
_MARK_SEEDS = "select landmark as node, rank as col, 1.0 as val from marks"
_FEATURES = f"with {_TRADE}, {_COL}, {_MARKS}, {_walk(5, _MARK_SEEDS)}, f as (select n.node, k.rank, coalesce(w.val, 0.0) as val from nodes n join marks k on true left join walk w on w.node = n.node and w.col = k.rank)"

_DISTANCE = {
    "w2": "sum((a.mu - b.mu) * (a.mu - b.mu) + (sqrt(a.v) - sqrt(b.v)) * (sqrt(a.v) - sqrt(b.v)))",
    "sym_kl": "0.5 * sum(a.v / b.v + b.v / a.v + (a.mu - b.mu) * (a.mu - b.mu) * (1 / a.v + 1 / b.v))",
    "sym_kl_compat": "sum(0.5 * (a.v / b.v + b.v / a.v) + a.mu * a.mu + b.mu * b.mu - a.mu * b.mu / b.v - a.mu * b.mu / a.v)",
}


def _distances(metric: str, digits: int) -> str:
    return f"select a.set_id as set_1, b.set_id as set_2, round({_DISTANCE[metric]}, {digits}) + 0.0 as distance from g a join g b using (k) group by 1, 2"


_UNIT = _V + ", u as (select gene, pos, k, x / greatest(sqrt(sum(x * x) over (partition by gene)), 1e-12) as x from e)"
_CONCISE = f"with {_G}, {_MEMBERS}, {_score('loglik')}, c as (select s.*, row_number() over (partition by set_id order by round(score, 9) desc, s.pos) as rank, count(*) over (partition by set_id) as n from s join m using (set_id, gene))"
_KEPT = "least(greatest(k, 5), 500)"

_LOW = 0xFFFFFFFF


def _mixed(rows: str, name: str, value: str) -> str:
    """`rows` with `name`, the 32-bit hash of `value`."""
    rows = f"select *, ({value}) & {_LOW}::ubigint as x0 from ({rows})"
    for k, step in enumerate(("xor(x0, x0 >> 16)", f"(x1 * {MIX_1}::ubigint) & {_LOW}::ubigint", "xor(x2, x2 >> 13)", f"(x3 * {MIX_2}::ubigint) & {_LOW}::ubigint", "xor(x4, x4 >> 16)")):
        rows = f"select *, {step} as x{k + 1} from ({rows})"
    return f"select * exclude (x0, x1, x2, x3, x4, x5), x5 as {name} from ({rows})"


def _permuted(nperm: int, seed: int = 1) -> str:
    """CTEs ending in perm (b, gene, stat): the statistics `st` dealt anew, as operators.permutation does it."""
    keys = _mixed(f"select unnest(range(1, {nperm + 1}))::ubigint as b", "own", f"b + {seed * SEED_STEP & _LOW}::ubigint")
    for t in range(ROUNDS):
        keys = _mixed(keys, f"k{t}", f"own + {t * ROUND_STEP & _LOW}::ubigint")

    def moved(rows: str) -> str:
        """(b, i, v) with v permuted once."""
        rows = f"select b, i, v // a as h, v % a as l, a, {', '.join(f'k{t}' for t in range(ROUNDS))} from ({rows}) join keys using (b) join size_of on true"
        for t in range(ROUNDS):
            rows = f"select * replace (l as h, (h + ((drawn * a) >> 32)) % a as l) from ({_mixed(rows, 'drawn', f'l + k{t}')})"
            rows = f"select * exclude (drawn) from ({rows})"
        return f"select b, i, h * a + l as v from ({rows})"

    return f"""numbered as (select gene, stat, (row_number() over (order by gene) - 1)::ubigint as i from st), size_of as (select count(*)::ubigint as n, greatest(16, ceil(sqrt(count(*))))::ubigint as a from st),
keys as ({keys}), walked as ({moved("select b, i, i as v from numbered, (select b from keys)")} union all {moved("select b, i, v from walked join size_of on v >= n")}),
perm as (select b, g.gene, s.stat from walked join size_of on v < n join numbered g using (i) join numbered s on s.i = v)"""


def _nulls(nperm: int) -> str:
    return _permuted(nperm) + """, es as (select set_id, sum(w.w * stat) as es from w join st using (gene) group by 1), nul as (select set_id, b, sum(w.w * stat) as v from w join perm using (gene) group by 1, 2),
mom as (select set_id, avg(v) as m, stddev_samp(v) as sd from nul group by 1)"""


_CORE = "core as (select set_id, string_agg(gene, '/' order by rank) as core_enrichment from (select set_id, gene, row_number() over (partition by set_id order by round(w.w, 12) desc, pos) as rank from w) where rank <= 30 group by 1)"
_SIZE = "size as (select set_id, count(*)::int as \"setSize\" from m join st using (gene) group by 1)"


def _tested(beyond: str, nperm: int = 20, weights: str = _W) -> str:
    return (
        f"with recursive {weights}, {_nulls(nperm)}, {_CORE}, {_SIZE}, t as (select set_id, any_value(es) as es, (any_value(es) - any_value(m)) / greatest(any_value(sd), 1e-8) as z, greatest(avg(case when {beyond} then 1.0 else 0.0 end), 1.0 / {nperm}) as p from nul join es using (set_id) join mom using (set_id) group by set_id),"
        " ranked as (select *, row_number() over (order by p, set_id) as i, count(*) over () as n from t), adj_p as (select *, least(1.0, min(p * n / i) over (order by i desc rows unbounded preceding)) as q from ranked)"
        ' select set_id as "ID", round(es, 4) + 0.0 as "ES", round(z, 4) + 0.0 as z, round(p, 6) + 0.0 as pvalue, round(q, 6) + 0.0 as p_adjust, "setSize", core_enrichment from adj_p join size using (set_id) join core using (set_id)'
    )


def _plain(stats: str) -> str:
    w = _W.replace(_STATS, stats)
    return f'with {w}, {_CORE}, {_SIZE}, es as (select set_id, sum(w.w * stat) as es from w join st using (gene) group by 1) select set_id as "ID", round(es, 4) + 0.0 as "ES", null::double as z, null::double as pvalue, null::double as p_adjust, "setSize", core_enrichment from es join size using (set_id) join core using (set_id)'


_BETAS = f"with {_SUPPLY}, {_W}, {_DEGREE}, {_SIZE}, h as (select 0.0::double as beta, set_id, gene, w.w from w union all select 0.5, set_id, gene, w from ({_hub(0.5)}) union all select 1.0, set_id, gene, w from ({_hub(1.0)})), es as (select beta, set_id, sum(h.w * stat) as es from h join st using (gene) group by 1, 2)"

_LABELS = _STATS.replace("p_retailprice as stat", "case when p_size > 25 then 1.0 else 0.0 end as stat")


def _swept(stats: str, nperm: int = 20) -> str:
    """All tests of a sweep over 0, 0.5 and 1, each beta's rates apart."""
    start = _BETAS[: _BETAS.index(", es as")].replace(_STATS, stats).replace("with ", "with recursive ", 1)
    return (
        f"{start}, {_permuted(nperm)}, es as (select beta, set_id, sum(h.w * stat) as es from h join st using (gene) group by 1, 2), nul as (select beta, set_id, b, sum(h.w * stat) as v from h join perm using (gene) group by 1, 2, 3),"
        " mom as (select beta, set_id, avg(v) as m, stddev_samp(v) as sd from nul group by 1, 2),"
        f" t as (select beta, set_id, any_value(es) as es, (any_value(es) - any_value(m)) / greatest(any_value(sd), 1e-8) as z, greatest(avg(case when abs(v - m) >= abs(es - m) - 1e-9 then 1.0 else 0.0 end), 1.0 / {nperm}) as p from nul join es using (beta, set_id) join mom using (beta, set_id) group by 1, 2),"
        " ranked as (select *, row_number() over (partition by beta order by p, set_id) as i, count(*) over (partition by beta) as n from t), adj_p as (select *, least(1.0, min(p * n / i) over (partition by beta order by i desc rows unbounded preceding)) as q from ranked)"
        ' select set_id as "ID", beta as degree_beta, round(es, 4) + 0.0 as "ES", round(z, 4) + 0.0 as z, round(p, 6) + 0.0 as pvalue, round(q, 6) + 0.0 as p_adjust, "setSize" from adj_p join size using (set_id)'
    )


SQL = {
    "graph_undirected": f"with {_SUPPLY} select src, dst, w from adj where w <> 0",
    "graph_directed": f"with {_TRADE} select src, dst, w from adj",
    "graph_self_loops": f"with {_TRADE} select src, dst, 2 * w as w from adj where src = dst",
    "graph_nodes_subset": f"with {_SUPPLY} select src, dst, w from adj where w <> 0 and (src in (select concat('P', p_partkey) from part where p_brand = 'Brand#11') or dst in (select concat('P', p_partkey) from part where p_brand = 'Brand#11'))",
    "transition_col": f"with {_TRADE}, {_COL} select src, dst, round(x, 6) + 0.0 as x from tr",
    "transition_row": f"with {_TRADE} select src, dst, round(w / greatest(sum(w) over (partition by src), 1e-12), 6) + 0.0 as x from adj",
    "degree_unweighted": f"with {_SUPPLY} select src as node, count(*)::double as degree from adj where w <> 0 group by 1",
    "degree_weighted": f"with {_SUPPLY} select src as node, sum(w)::double as degree from adj group by 1",
    "landmarks_degree": f"with {_SUPPLY} select src as landmark, row_number() over (order by count(*) desc, src) as rank from adj where w <> 0 group by 1 order by rank limit 16",
    "landmarks_random": f"with {_SUPPLY} select src as landmark, row_number() over (order by md5(concat_ws('|', '1', src)), src) as rank from (select distinct src from adj) order by rank limit 16",
    "walk_steps": f"with {_TRADE}, {_COL}, {_walk(5, _REGION_SEEDS)} select node, col, round(val, 6) + 0.0 as val from walk",
    "walk_blocks": f"with {_TRADE}, {_COL}, {_walk(5, _REGION_SEEDS)} select node, col, round(val, 6) + 0.0 as val from walk",
    "node_features": _FEATURES + " select node, rank, round(val, 6) + 0.0 as val from f",
    "set_features": f"with {_TRADE}, {_COL}, {_MARKS}, {_walk(5, _REGION_SEEDS)}, sets as (select distinct col from seed) select s.col as set_id, k.rank, round(coalesce(w.val, 0.0), 6) + 0.0 as val from sets s join marks k on true left join walk w on w.col = s.col and w.node = k.landmark",
    "walk_converged": f"with {_SUPPLY}, {_COL}, {_MARKS_16}, {_walk(45, _MARK_SEEDS)} select node, round(max(val), 6) + 0.0 as most, round(sum(val), 6) + 0.0 as mass from walk group by 1",
    "svd_gram": _FEATURES + ", c as (select node, rank, val - avg(val) over (partition by rank) as x from f) select a.node as gene_1, b.node as gene_2, round(sum(a.x * b.x), 8) + 0.0 as product from c a join c b using (rank) group by 1, 2",
    "set_gaussians": f"with {_G} select set_id, k, round(mu, 6) as mu, round(v, 6) as var from g",
    "gaussians_edge_cases": "select label::varchar as set_id, 1 as n, round(arg_min(embedding[1]::double, vec_id), 6) as mu_0, 1e-8 as var_0 from embeddings group by label union all select 'suppliers', 0, null, null",
    "cosine_top": f"with {_UNIT}, c as (select a.gene as gene_1, b.gene as gene_2, sum(a.x * b.x) as s from u a join u b using (k) where a.gene <> b.gene group by 1, 2), n as (select *, row_number() over (partition by gene_1 order by round(s, 9) desc, gene_2) as rank from c) select gene_1, gene_2, round(s, 6) + 0.0 as similarity, rank from n where rank <= 10",
    "cosine_subset": f"with {_UNIT.replace('u as (select gene', 'u as (select label, gene')} select a.gene as gene_1, b.gene as gene_2, round(sum(a.x * b.x), 6) + 0.0 as similarity from u a join u b using (k) where a.label::varchar = '0' and b.label::varchar in ('1', '2') group by 1, 2",
    "cosine_mean": f"with {_UNIT}, n as (select count(*) as n from embeddings), t as (select k, sum(x) as t from u group by 1) select gene as gene_1, round(sum(x * t) / any_value(n), 6) + 0.0 as mean, any_value(n) as n from u join t using (k) join n on true group by 1",
    **{f"distance_{m}": f"with {_G} {_distances(m, 4)}" for m in _DISTANCE},
    "closest_sets": f"with {_G}, d as ({_distances('w2', 6)}) select * from d where set_1 < set_2 order by distance, set_1, set_2 limit 10",
    "cluster_w2": f"with {_V.replace('label,', 'label, concat_ws(chr(45), label::varchar, (vec_id % 13)::varchar) as cluster,')}, g as (select cluster as set_id, k, avg(x) as mu, greatest(var_samp(x), 1e-8) as v from e group by 1, 2 having count(*) >= 4) {_distances('w2', 6)}",
    "cluster_sym_kl": f"with {_V.replace('label,', 'label, concat_ws(chr(45), label::varchar, (vec_id % 13)::varchar) as cluster,')}, g as (select cluster as set_id, k, avg(x) as mu, greatest(var_samp(x), 1e-8) as v from e group by 1, 2 having count(*) >= 4) {_distances('sym_kl', 6)}",
    "all_similarities": f"with {_G}, u as (select gene, k, x / greatest(sqrt(sum(x * x) over (partition by gene)), 1e-12) as x from e) select 'gene_gene' as what, a.gene as id_1, b.gene as id_2, round(sum(a.x * b.x), 4) + 0.0 as value from u a join u b using (k) group by 2, 3"
    + "".join(f" union all select '{what}', * from ({_distances(metric, 4)})" for what, metric in (("set_set_w2", "w2"), ("set_set_kl", "sym_kl"))),
    "wide_embedding": "select vec_id::varchar as gene, round(list_sum(list_transform(embedding[1:8], lambda x: x::double * x::double)), 6) + 0.0 as square from embeddings",
    **{f"score_{s}": f"with {_G}, {_score(s)} select set_id, gene, round(score, 4) + 0.0 as score from s" for s in ("loglik", "neg_mahalanobis")},
    "concise_top_n": _CONCISE + " select set_id, gene, rank from c where rank <= 20",
    "concise_mass": _CONCISE + f", z as (select *, exp((score - max(score) over (partition by set_id)) / 8) as z from c), y as (select *, sum(z) over (partition by set_id order by rank) as run, sum(z) over (partition by set_id) as total from z), t as (select set_id, min(rank) as k from y where run >= (0.8 - 1e-12) * total group by 1) select set_id, gene, rank from c join t using (set_id) where rank <= {_KEPT}",
    "concise_quantile": _CONCISE + f", q as (select set_id, quantile_cont(score, 0.7) as cut from c group by 1), t as (select set_id, count(*) as k from c join q using (set_id) where score >= cut group by 1) select set_id, gene, rank from c join t using (set_id) where rank <= {_KEPT}",
    "concise_threshold": _CONCISE + f", t as (select set_id, count(*) filter (where score >= 90.0) as k from c group by 1) select set_id, gene, rank from c join t using (set_id) where rank <= {_KEPT}",
    "concise_unrestricted": f"with {_G}, {_score('loglik')}, c as (select *, row_number() over (partition by set_id order by round(score, 9) desc, pos) as rank from s) select set_id, gene, rank from c where rank <= 20",
    "concise_mass_unrestricted": f"with {_G}, {_score('loglik')}, c as (select *, row_number() over (partition by set_id order by round(score, 9) desc, pos) as rank from s), z as (select *, exp((score - max(score) over (partition by set_id)) / 8) as z from c), y as (select *, sum(z) over (partition by set_id order by rank) as run, sum(z) over (partition by set_id) as total from z), t as (select set_id, min(rank) as k from y where run >= (0.8 - 1e-12) * total group by 1) select set_id, gene, rank from c join t using (set_id) where rank <= {_KEPT}",
    "soft_membership": f"with {_W} select set_id, gene, round(w, 6) + 0.0 as w from w",
    "soft_membership_restricted": f"with {_W_MEMBERS} select set_id, gene, round(w, 6) + 0.0 as w from w",
    "hub_weights": f"with {_SUPPLY}, {_W}, {_DEGREE}, h as ({_hub(0.5)}) select set_id, gene, round(w, 6) + 0.0 as w from h",
    "gsea_scores": _plain(_STATS),
    "ora_scores": _plain(_LABELS),
    "gsea_two_sided": _tested("abs(v - m) >= abs(es - m) - 1e-9"),
    "gsea_greater": _tested("v >= es - 1e-9"),
    "gsea_less": _tested("v <= es + 1e-9"),
    "gsea_1000": _tested("abs(v - m) >= abs(es - m) - 1e-9", 1000),
    "ora_tested": _tested("abs(v - m) >= abs(es - m) - 1e-9", 50, _W.replace(_STATS, _LABELS)),
    **{f"sweep_tested_{mode}": _swept(stats) for mode, stats in (("gsea", _STATS), ("ora", _LABELS))},
    "perm_null": f"with recursive {_W}, {_nulls(20)} select set_id, b::int as b, round(v, 4) + 0.0 as null_score from nul",
    "sweep_long": _BETAS + ' select set_id as "ID", beta as degree_beta, round(es, 4) + 0.0 as "ES", "setSize" from es join size using (set_id)',
    "sweep_compare": _BETAS + """, p as (select set_id, max(es) filter (where beta = 0) as a, max(es) filter (where beta = 0.5) as b, max(es) filter (where beta = 1) as c from es group by 1)
select set_id as "ID", round(a, 4) + 0.0 as "ES_beta_0", round(b, 4) + 0.0 as "ES_beta_0.5", round(c, 4) + 0.0 as "ES_beta_1", round(b - a, 4) + 0.0 as "deltaES_vs0_0.5", round(c - a, 4) + 0.0 as "deltaES_vs0_1" from p""",
    "event_scores": f"with {_W} select concat(strftime(date_trunc('day', ts), '%Y-%m-%d'), ' 00:00:00') as day, set_id, round(sum(w.w * value), 4) + 0.0 as \"ES\", count(*) as n_genes from events join w on gene = concat('P', user_id) where value is not null group by 1, 2",
}
