"""SQL of the queries in this subpackage that SQL can express on whole tables."""

_RECORDS = r"""with f as (select edge_id, upper(regexp_replace(node1, '[^A-Za-z0-9]', '', 'g')) a, upper(regexp_replace(node2, '[^A-Za-z0-9]', '', 'g')) b,
  try_cast(nullif(regexp_extract(replace(weight_text, ',', '.'), '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?'), '') as double) w from ppi),
g as (select edge_id, min(edge_id) over (partition by least(a, b), greatest(a, b), w) as first_edge_id from f where a <> '' and b <> '')"""

_TOP = """with b as (select set_id, gene, max(score) as score from gsemb_gene_to_set_score where score is not null and not isnan(score) and set_id is not null and gene is not null group by set_id, gene),
l as (select set_id, max(coalesce(top_n, 50)) as n from gsemb_make_concise_gene_sets group by set_id),
r as (select b.set_id, gene, score, n, row_number() over (partition by b.set_id order by score desc, gene) as rank from b join l on b.set_id = l.set_id)"""

_SETS = """with c as (select set_id, revision, row_id, list_sort(list_distinct(list_filter(list_transform(gene_sets, lambda x: upper(trim(x))), lambda x: x is not null and x <> ''))) as m from gene_sets where set_id is not null),
s as (select set_id, arg_max(m, revision) as m from c group by set_id)"""

_PAIRS = _SETS + """, l as (select set_id, unnest(m) as gene from s), k as (select set_id, count(*) as n from l group by set_id),
o as (select a.set_id as x, b.set_id as y, count(*) as common from l a join l b on a.gene = b.gene and a.set_id < b.set_id group by 1, 2)"""

_TOGETHER = _SETS + """, l as (select set_id, unnest(m) as gene from s), k as (select gene, count(*) as n from l group by gene), t as (select count(distinct set_id) as n from l),
o as (select a.gene as gene_1, b.gene as gene_2, count(*) as n12 from l a join l b on a.set_id = b.set_id and a.gene < b.gene group by 1, 2 having count(*) >= 8)"""

SQL = {
    "p2_counts": _TOGETHER + " select gene_1, gene_2, n12, x.n as n1, y.n as n2 from o join k x on x.gene = gene_1 join k y on y.gene = gene_2",
    "p2_found": _TOGETHER + " select gene_1, gene_2 from o join k x on x.gene = gene_1 join k y on y.gene = gene_2 cross join t where n12 * t.n >= 4 * x.n * y.n",
    "p3_found": _PAIRS + " select x as set_id_1, y as set_id_2 from o join k kx on kx.set_id = x join k ky on ky.set_id = y where common * 5 >= 4 * (kx.n + ky.n - common)",
    "p3_between": _SETS + """, l as (select row_id, unnest(m) as gene from c), r as (select set_id, unnest(m) as gene from s), kl as (select row_id, count(*) as n from l group by 1), kr as (select set_id, count(*) as n from r group by 1),
o as (select row_id, set_id, count(*) as common from l join r using (gene) group by 1, 2) select row_id, set_id from o join kl using (row_id) join kr using (set_id) where common * 5 >= 4 * (kl.n + kr.n - common)""",
    "p5_records": _RECORDS + " select first_edge_id, count(*) as copies from g group by first_edge_id",
    "p5_found": _RECORDS + " select first_edge_id, edge_id from g where edge_id > first_edge_id",
    "p6_top": _TOP + " select set_id, gene, score, rank from r where rank <= n",
    "p6_found": _TOP + " select set_id, gene from r where rank <= n",
}
