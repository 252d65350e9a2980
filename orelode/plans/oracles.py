"""DuckDB SQL for the registered queries, from shared pieces."""

from __future__ import annotations

from orelode.operators.lsh import HASHES, ROWS, coefficients

RATINGS = """ratings as (select o_custkey as user_id, l_partkey as item_id, max(l_quantity) / 10.0 as rating
    from orders join lineitem on o_orderkey = l_orderkey group by o_custkey, l_partkey),
train as (select * from ratings where (user_id * 31 + item_id) % 10 <> 0),
test as (select * from ratings where (user_id * 31 + item_id) % 10 = 0),
umean as (select user_id, avg(rating) as mean from train group by user_id)"""

GENRES = """words as (select p_partkey as item_id, unnest(string_split(p_name, ' ')) as genre from part),
genres as (select distinct item_id, genre from (select * from words union all select p_partkey, p_type from part))"""

BASKETS = """baskets as (select distinct o_custkey as user_id, p_brand || '/' || cast(p_size as varchar) as item
    from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey),
edges as (select a.user_id as src, b.user_id as dst, count(*) as shared from baskets a join baskets b on a.item = b.item and a.user_id < b.user_id
    group by all having count(*) >= 9),
g as (select src as a, dst as b from edges union all select dst, src from edges)"""

LINES = "lines as (select unnest(string_split(text, chr(10))) as value from documents)"

TOKENS = r"""tokens as (select distinct doc_id as id, token from
    (select doc_id, unnest(string_split_regex(lower(text), '\W+')) as token from documents) where token <> '')"""

BFS = """bfs(r, n, d) as (select distinct a, a, 0 from g union select r, g.b, d + 1 from bfs join g on g.a = bfs.n where d < 16),
lv as (select r, n, min(d) as d from bfs group by r, n)"""

BETWEEN = """dag as (select p.r, p.n as p, c.n as c from lv p join g on g.a = p.n join lv c on c.r = p.r and c.n = g.b and c.d = p.d + 1),
np as (select r, c, count(*) as k from dag group by r, c),
dk as (select dag.r, p, c, 1.0::double / k as x from dag join np using (r, c)),
w(r, t, p, c, x) as (select r, c, p, c, x from dk union all select w.r, w.t, dk.p, dk.c, w.x * dk.x from w join dk on dk.r = w.r and dk.c = w.p),
bw as (select p as src, c as dst, sum(x) / 2 as betweenness from w where p < c group by p, c)"""


def pearson(side: str, shared: str, source: str = "train") -> str:
    flat = "min(a.rating) = max(a.rating) or min(b.rating) = max(b.rating)"
    return f"""select a.{side} as id1, b.{side} as id2, count(*) as n,
    coalesce(case when {flat} then 0.0 else covar_pop(a.rating, b.rating) / (stddev_pop(a.rating) * stddev_pop(b.rating)) end, 0.0) as sim
    from {source} a join {source} b on a.{shared} = b.{shared} and a.{side} < b.{side} group by a.{side}, b.{side}"""


def nearest(k: int, universe: str) -> str:
    """(id, other, sim) from ps; zero similarities take places without being listed."""
    return f"""both_ as (select id1 as id, id2 as other, sim, round(round(sim, 9), 6) as r from ps union all select id2, id1, sim, round(round(sim, 9), 6) from ps),
placed as (select id, other, sim, r, case when r < 0 then (select count(distinct {universe}) from train) - 1
        - sum(case when r < 0 then 1 else 0 end) over (partition by id) + row_number() over (partition by id, r < 0 order by r desc, other)
        else row_number() over (partition by id order by r desc, other) end as place from both_),
near as (select id, other, sim from placed where place <= {k} and r <> 0)"""



def user_cf(weight: str = "sim") -> str:
    """Predictions of the user neighbourhood, each neighbour weighing ``weight`` of near's columns."""
    return f"""ps as ({pearson("user_id", "item_id")}), {nearest(250, "user_id")},
weighed as (select id, other, {weight} as sim from near join ps on id1 = least(id, other) and id2 = greatest(id, other)),
sums as (select user_id, sum(rating) as s, count(*) as c from train group by user_id),
others as (select t.user_id as other, item_id, rating - (s - rating) / (c - 1) as dev from train t join sums using (user_id) where c > 1),
votes as (select t.user_id, t.item_id, sum(sim * dev) as top, sum(abs(sim)) as w from test t join weighed on weighed.id = t.user_id
    join others o on o.other = weighed.other and o.item_id = t.item_id group by t.user_id, t.item_id),
pred as (select t.user_id, t.item_id, least(mean + coalesce(case when w = 0 then null else top / w end, 0), 5.0) as prediction, w
    from test t join umean using (user_id) left join votes using (user_id, item_id))"""


USER_CF = user_cf("near.sim")

ITEM_CF = f"""ps as ({pearson("item_id", "user_id")}), {nearest(10, "item_id")},
votes as (select t.user_id, t.item_id, sum(r.rating * sim) / nullif(sum(abs(sim)), 0) as p from test t join near on near.id = t.item_id
    join train r on r.user_id = t.user_id and r.item_id = near.other group by t.user_id, t.item_id),
pred as (select t.user_id, t.item_id, coalesce(p, mean) as prediction from test t join umean using (user_id) left join votes using (user_id, item_id))"""

ITEM_SETS = """inter as (select a.item_id as id1, b.item_id as id2, count(*) as c from train a join train b on a.user_id = b.user_id and a.item_id < b.item_id group by all),
ns as (select item_id, count(*) as n from train group by item_id),
jac as (select id1, id2, c::double / (x.n + y.n - c) as jaccard from inter join ns x on x.item_id = id1 join ns y on y.item_id = id2)"""

CONTENT = """gn as (select item_id, count(*) as n from genres group by item_id),
sh as (select t.user_id, t.item_id, r.item_id as other, r.rating, count(*) as c from test t join train r on r.user_id = t.user_id and r.item_id <> t.item_id
    join genres a on a.item_id = t.item_id join genres b on b.item_id = r.item_id and a.genre = b.genre group by all),
wt as (select sh.user_id, sh.item_id, rating, c / sqrt(x.n * y.n) as w from sh join gn x on x.item_id = sh.item_id join gn y on y.item_id = sh.other),
votes as (select user_id, item_id, sum(rating * w) / sum(w) as p from wt group by user_id, item_id),
pred as (select t.user_id, t.item_id, coalesce(p, mean) as prediction from test t join umean using (user_id) left join votes using (user_id, item_id))"""


def signature_sql() -> str:
    mins = ", ".join(f"min(({a} * x + {b}) % (select count(distinct token) + 1 from tokens)) as h{k}" for k, (a, b) in enumerate(coefficients()))
    return f"sig as (select id, {mins} from (select id, ('0x' || substr(md5(token), 1, 8))::bigint as x from tokens) group by id)"


def band_sql() -> str:
    parts = [f"select id, {k // ROWS} as band, list_sort(list_distinct([{', '.join(f'h{k + r}' for r in range(ROWS))}])) as key from sig" for k in range(0, HASHES, ROWS)]
    return "bands as (" + " union all ".join(parts) + ")"


CANDIDATES = "cand as (select distinct a.id as id1, b.id as id2 from bands a join bands b on a.band = b.band and a.key = b.key and a.id < b.id)"
EXACT = """tn as (select id, count(*) as n from tokens group by id),
ti as (select a.id as id1, b.id as id2, count(*) as c from tokens a join tokens b on a.token = b.token and a.id < b.id group by all),
exact as (select id1, id2, c::double / (x.n + y.n - c) as jaccard from ti join tn x on x.id = id1 join tn y on y.id = id2 where c::double / (x.n + y.n - c) >= 0.5)"""

ITEMSETS = """b as (select distinct l_orderkey as basket, p_brand as item from lineitem join part on l_partkey = p_partkey),
n as (select count(distinct basket) as n from b),
s1 as (select item as a, count(*) as freq from b group by item),
s2 as (select x.item as a, y.item as b, count(*) as freq from b x join b y on x.basket = y.basket and x.item < y.item group by all),
s3 as (select x.item as a, y.item as b, z.item as c, count(*) as freq from b x join b y on x.basket = y.basket and x.item < y.item
    join b z on z.basket = x.basket and y.item < z.item group by all)"""


def predictions(body: str, columns: str = "user_id, item_id, round(round(prediction, 9), 6) + 0.0 as prediction") -> str:
    return f"with {body} select {columns} from pred"


def rmse(body: str) -> str:
    return f"with {body} select count(*) as n, round(round(sqrt(avg((t.rating - p.prediction) * (t.rating - p.prediction))), 9), 6) as rmse from test t join pred p using (user_id, item_id)"
