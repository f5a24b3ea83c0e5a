"""DuckDB SQL giving the same rows as the catalogue's queries.

Written from the definitions, without the tricks the Spark side uses: plain
window functions and full comparisons over whole tables.
"""

import re

from lodestream.plans.catalog import INITS, LR, REG

DIM = 64
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
MID = "TIMESTAMP '2024-01-16 00:00:00'"


def r6(x: str) -> str:
    return f"(CASE WHEN abs({x}) < 0.0000005 THEN 0.0::DOUBLE ELSE round({x}, 6) END)"


def prints(v: str, name: str) -> str:
    return (
        f"len({v})::BIGINT AS {name}_n, {r6(f'coalesce(list_sum({v}), 0.0)')} AS {name}_sum, "
        f"{r6(f'coalesce(list_sum(list_transform({v}, lambda x, i: x * i)), 0.0)')} AS {name}_moment"
    )


def dot(a, b):
    return f"list_dot_product({a}, {b})"


def norm(a):
    return f"sqrt({dot(a, a)})"


def cos(a, b):
    return f"(CASE WHEN {norm(a)} = 0 OR {norm(b)} = 0 THEN 0.0 ELSE {dot(a, b)} / ({norm(a)} * {norm(b)}) END)"


def u32(id_, i, seed):
    """Word i of the draws of an id: four to a digest."""
    return f"('0x' || substr(md5({id_} || ':' || ({i} // 4) || ':{seed}'), 1 + 8 * ({i} % 4)::INT, 8))::UBIGINT"


def draw(id_, i, seed):
    return f"({u32(id_, i, seed)}::DOUBLE / 4294967296.0)"


def normal(id_, i, seed):
    u1 = f"(({u32(id_, i, f'{seed}:r')}::DOUBLE + 0.5) / 4294967296.0)"
    return f"(sqrt(-2.0 * ln({u1})) * cos({2 * 3.141592653589793} * {draw(id_, i, f'{seed}:a')}))"


def init_element(method, id_, i, dim, seed, low=None, high=None, mean=None, std_dev=None, value=None, sparsity=None):
    wide, narrow = (6.0 / dim) ** 0.5, (3.0 / dim) ** 0.5
    spans = {
        "xavier_uniform": (-wide, wide),
        "he_uniform": (-wide, wide),
        "lecun_uniform": (-narrow, narrow),
        "uniform": (low, high),
    }
    bells = {
        "xavier_normal": (0.0, (2.0 / dim) ** 0.5),
        "he_normal": (0.0, (2.0 / dim) ** 0.5),
        "lecun_normal": (0.0, (1.0 / dim) ** 0.5),
        "normal": (mean, std_dev),
    }
    if method in spans:
        a, b = spans[method]
        return f"({a!r}::DOUBLE + {b - a!r}::DOUBLE * {draw(id_, i, seed)})"
    if method in bells:
        m, s = bells[method]
        return f"({m!r}::DOUBLE + {s!r}::DOUBLE * {normal(id_, i, seed)})"
    if method == "sparse":
        return (
            f"(CASE WHEN {draw(id_, i, f'{seed}:drop')} < {sparsity!r}::DOUBLE THEN 0.0 "
            f"ELSE -1.0 + 2.0 * {draw(id_, i, seed)} END)"
        )
    fill = {"zeros": 0.0, "ones": 1.0}.get(method, value)
    return f"{fill!r}::DOUBLE"


def init_list(method, id_, dim, seed, **params):
    element = init_element(method, f"({id_})::VARCHAR", "i", dim, seed, **params)
    return f"list_transform(range({dim}), lambda i: {element})"


WEIGHT = (
    "(CASE action_type WHEN 'View' THEN 0.1 WHEN 'Click' THEN 0.3 WHEN 'Like' THEN 0.7 "
    "WHEN 'Share' THEN 0.8 WHEN 'Purchase' THEN 1.0 WHEN 'Convert' THEN 1.0 END)::DOUBLE"
)
RELEVANT_KINDS = "('Purchase', 'Convert')"


def fold(where: str) -> str:
    """Profiles by the closed form over all chosen actions."""
    return f"""
      SELECT user_id, list(x ORDER BY i) AS embedding, any_value(n) AS interaction_count, any_value(latest) AS last_updated
      FROM (SELECT user_id, i, sum(0.1 * weight * pow(0.9, age) * embedding[i]) AS x, count(*) AS n, max(ts) AS latest
            FROM (SELECT w.*, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age
                  FROM weighted w WHERE item_id IN (SELECT item_id FROM items) AND {where}) a
            JOIN items USING (item_id), range(1, {DIM + 1}) r(i)
            GROUP BY user_id, i)
      GROUP BY user_id"""


def top(queries, items, q, i, score, k, extra="true"):
    """Best k of items per query by score, ties by id."""
    return f"""
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY {q} ORDER BY round(score, 9) DESC, {i}) AS rank
        FROM (SELECT q.{q}, v.{i}, {score} AS score FROM {queries} q, {items} v WHERE {extra}))
      WHERE rank <= {k}"""


def sgd(users, items, lr):
    """One gradient step as two lists of CTE bodies (users, items)."""
    pairs = f"""(SELECT e.*, u.vector AS u, v.vector AS i, e.label - {dot('u.vector', 'v.vector')} AS err
                 FROM examples e JOIN {users} u USING (user_id) JOIN {items} v USING (item_id))"""

    def side(table, key, own, other):
        moved = f"""SELECT {key}, list(x ORDER BY d) AS vector FROM (
            SELECT {key}, d, any_value({own}[d]) + {lr} * sum(err * {other}[d] - {REG} * {own}[d]) AS x
            FROM {pairs} p, range(1, {DIM + 1}) r(d) GROUP BY {key}, d) GROUP BY {key}"""
        return f"""SELECT t.{key}, coalesce(n.vector, t.vector) AS vector
                   FROM {table} t LEFT JOIN ({moved}) n USING ({key})"""

    return side(users, "user_id", "u", "i"), side(items, "item_id", "i", "u")


STEP_USERS, STEP_ITEMS = sgd("user_factors", "item_factors", LR)
T1_USERS, T1_ITEMS = sgd("user_factors", "item_factors", 0.01)
T2_USERS, T2_ITEMS = sgd("train1_users", "train1_items", 0.01)

DAMAGED = """
      SELECT vec_id, nullif(vec_id, 0) AS id, label,
        CASE WHEN vec_id % 25 = 7 THEN NULL WHEN vec_id % 25 = 8 THEN list_append(embedding::DOUBLE[], NULL::DOUBLE)
        ELSE CASE label WHEN 1 THEN []::DOUBLE[] WHEN 2 THEN list_append(embedding::DOUBLE[], 'NaN'::DOUBLE)
          WHEN 3 THEN list_prepend('-Infinity'::DOUBLE, embedding::DOUBLE[])
          WHEN 4 THEN flatten(list_transform(range(33), lambda z: embedding::DOUBLE[]))
          ELSE embedding::DOUBLE[] END END AS vector
      FROM embeddings"""


def broken(v):
    return f"(len(list_filter({v}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0)"


def vector_error(id_, v, what, nil="User ID cannot be nil"):
    return f"""CASE WHEN {id_} IS NULL THEN '{nil}' WHEN coalesce(len({v}), 0) = 0 THEN '{what} cannot be empty'
      WHEN {broken(v)} THEN '{what} contains invalid values (NaN or Infinity)'
      WHEN len({v}) > 2048 THEN '{what} dimension too large (max 2048)'"""


CTES = {
    "logged": """SELECT event_id, user_id, (json_extract_string(props, '$.k'))::BIGINT AS item_id,
      CASE event_type WHEN 'view' THEN 'View' WHEN 'click' THEN 'Click' WHEN 'purchase' THEN 'Purchase'
        WHEN 'signup' THEN 'Convert' ELSE event_type END AS action_type, ts FROM events""",
    "actions": "SELECT * FROM logged WHERE action_type <> 'error'",
    "weighted": f"SELECT *, {WEIGHT} AS weight FROM actions",
    "items": "SELECT vec_id AS item_id, embedding::DOUBLE[] AS embedding, 'c' || label AS category FROM embeddings",
    "acted": "SELECT item_id, count(*) AS n FROM actions GROUP BY item_id",
    "popularity": """SELECT item_id, coalesce(n, 0) / (SELECT max(n) FROM acted)::DOUBLE AS popularity
      FROM items LEFT JOIN acted USING (item_id)""",
    "people": "SELECT DISTINCT user_id FROM events",
    "profiles": fold("true"),
    "early_profiles": fold(f"ts < {MID}"),
    "late_profiles": fold(f"ts >= {MID}"),
    "examples": """SELECT event_id, user_id, item_id, weight AS label, ts FROM weighted
      WHERE item_id IN (SELECT item_id FROM items)""",
    "user_factors": f"SELECT user_id, {init_list('xavier_uniform', 'user_id', DIM, 0)} AS vector FROM people",
    "item_factors": "SELECT item_id, embedding AS vector FROM items",
    "step_users": STEP_USERS,
    "step_items": STEP_ITEMS,
    "train1_users": T1_USERS,
    "train1_items": T1_ITEMS,
    "train2_users": T2_USERS,
    "train2_items": T2_ITEMS,
    "requests": """SELECT user_id, CASE WHEN user_id % 3 = 0 THEN ['c1', 'c3', 'c5', 'c7', 'c8'] END AS cats,
      CASE WHEN user_id % 5 = 0 THEN range(50) END AS gone FROM people""",
    "candidates": top("profiles", "items", "user_id", "item_id", cos("q.embedding", "v.embedding"), 20),
    "plain_candidates": """
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank
      FROM (SELECT u.user_id, v.item_id, coalesce(%s, 0.0) AS score, coalesce(%s, 0.0) AS flat
            FROM people u LEFT JOIN profiles q USING (user_id), items v) QUALIFY rank <= 6"""
    % (cos("q.embedding", "v.embedding"), dot("q.embedding", "v.embedding")),
    "recs": f"""
      SELECT user_id, item_id, final AS score, category,
        row_number() OVER (PARTITION BY user_id ORDER BY round(final, 9) DESC, rank) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS turn FROM (
          SELECT c.user_id, c.item_id, c.rank, i.category, (c.score + {dot('p.embedding', 'i.embedding')}) / 2 AS final
          FROM candidates c JOIN items i USING (item_id) JOIN profiles p USING (user_id) JOIN requests r USING (user_id)
          WHERE (gone IS NULL OR NOT list_contains(gone, c.item_id))
            AND (cats IS NULL OR list_contains(cats, i.category))) WHERE final >= 0.2) WHERE turn <= 10""",
    "relevant": f"SELECT DISTINCT user_id, item_id FROM actions WHERE action_type IN {RELEVANT_KINDS}",
    "grades": "SELECT user_id, item_id, max(weight) AS grade FROM weighted GROUP BY ALL",
    "precision_recall": """
      SELECT user_id, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM (
        SELECT user_id,
          coalesce((SELECT count(*) FROM recs x JOIN relevant y USING (user_id, item_id) WHERE x.user_id = u.user_id AND x.rank <= 5)
            / nullif(least(5, (SELECT count(*) FROM recs x WHERE x.user_id = u.user_id)), 0)::DOUBLE, 0.0) AS p,
          coalesce((SELECT count(*) FROM recs x JOIN relevant y USING (user_id, item_id) WHERE x.user_id = u.user_id AND x.rank <= 5)
            / nullif((SELECT count(*) FROM relevant y WHERE y.user_id = u.user_id), 0)::DOUBLE, 0.0) AS r
        FROM people u)""",
    "ndcg": """
      SELECT user_id, CASE WHEN coalesce(idcg, 0) = 0 THEN 0.0 ELSE coalesce(dcg, 0.0) / idcg END AS ndcg FROM people
      LEFT JOIN (SELECT user_id, sum(grade / log2(rank + 1)) AS dcg FROM recs JOIN grades USING (user_id, item_id)
                 WHERE rank <= 5 GROUP BY user_id) USING (user_id)
      LEFT JOIN (SELECT user_id, sum(grade / log2(place + 1)) AS idcg FROM (
                   SELECT user_id, grade, row_number() OVER (PARTITION BY user_id ORDER BY grade DESC) AS place FROM grades)
                 WHERE place <= 5 GROUP BY user_id) USING (user_id)""",
    "relevant_ndcg": """
      SELECT user_id, CASE WHEN coalesce(idcg, 0) = 0 THEN 0.0 ELSE coalesce(dcg, 0.0) / idcg END AS ndcg FROM people
      LEFT JOIN (SELECT user_id, sum(1.0 / log2(rank + 1)) AS dcg FROM recs JOIN relevant USING (user_id, item_id)
                 WHERE rank <= 5 GROUP BY user_id) USING (user_id)
      LEFT JOIN (SELECT user_id, sum(1.0 / log2(place + 1)) AS idcg FROM (
                   SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS place FROM relevant)
                 WHERE place <= 5 GROUP BY user_id) USING (user_id)""",
    "ap": """
      SELECT user_id, coalesce(gained / nullif(owned, 0)::DOUBLE, 0.0) AS ap FROM people
      LEFT JOIN (SELECT user_id, count(*) AS owned FROM relevant GROUP BY user_id) USING (user_id)
      LEFT JOIN (SELECT user_id, sum(hit * found / rank::DOUBLE) AS gained FROM (
          SELECT user_id, rank, hit, sum(hit) OVER (PARTITION BY user_id ORDER BY rank) AS found FROM (
            SELECT x.user_id, x.rank, CASE WHEN y.item_id IS NULL THEN 0 ELSE 1 END AS hit
            FROM recs x LEFT JOIN relevant y USING (user_id, item_id) WHERE x.rank <= 5))
        GROUP BY user_id) USING (user_id)""",
    "list_diversity": """
      SELECT user_id, coalesce(d, 0.0) AS diversity FROM people LEFT JOIN (
        SELECT a.user_id, avg(list_distance(x.embedding, y.embedding)) AS d
        FROM recs a JOIN recs b ON a.user_id = b.user_id AND a.rank < b.rank
        JOIN items x ON x.item_id = a.item_id JOIN items y ON y.item_id = b.item_id GROUP BY a.user_id) USING (user_id)""",
    "list_novelty": """
      SELECT user_id, coalesce(b, 0.0) AS novelty FROM people LEFT JOIN (
        SELECT user_id, avg(CASE WHEN popularity > 0 THEN -log2(popularity) ELSE 0.0 END) AS b
        FROM recs LEFT JOIN popularity USING (item_id) GROUP BY user_id) USING (user_id)""",
    "covered": """SELECT count(*) FILTER (item_id IN (SELECT item_id FROM recs)) / count(*)::DOUBLE AS coverage FROM items""",
    "visits": """
      SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n_events,
        (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_seconds, count(*) = 1 AS bounced FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
          SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh
          FROM actions WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
      GROUP BY user_id, session""",
    "heat": f"""
      SELECT item_id, sum(weight * exp(-0.01 * trunc((epoch_us({AS_OF}) - epoch_us(ts)) / 1e6) / 3600.0)) AS score
      FROM weighted GROUP BY item_id""",
    "trends": "SELECT item_id, score, category FROM heat JOIN items USING (item_id)",
    "damaged": DAMAGED,
    "damaged_items": """
      SELECT vec_id, id, vector, CASE label WHEN 5 THEN '' WHEN 6 THEN repeat('é', 51) ELSE 'c' || label END AS category,
        CASE label WHEN 7 THEN 1.5 WHEN 8 THEN -0.25 ELSE 0.5 END AS popularity FROM damaged""",
    "item_errors": f"""
      SELECT vec_id, {vector_error('id', 'vector', 'Item embedding', 'Item ID cannot be nil')}
        WHEN category = '' THEN 'Item category cannot be empty'
        WHEN strlen(category) > 100 THEN 'Item category too long (max 100 characters)'
        WHEN popularity < 0 OR popularity > 1 THEN 'Item popularity score must be between 0.0 and 1.0' END AS error
      FROM damaged_items""",
    "pairs": "SELECT DISTINCT l_suppkey AS user_id, l_partkey AS item_id FROM lineitem",
    "pair_scores": f"""
      SELECT user_id, item_id, coalesce({cos('p.embedding', 'i.embedding')}, 0.0) AS score
      FROM pairs LEFT JOIN profiles p USING (user_id) LEFT JOIN items i USING (item_id)""",
    "neighbours": """
      SELECT a.vec_id, CASE WHEN a.label = 1 THEN list_transform(a.embedding, lambda x: x * 0) ELSE a.embedding END::DOUBLE[] AS a,
        CASE WHEN b.label = 0 THEN b.embedding[1:10] ELSE b.embedding END::DOUBLE[] AS b
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "item_gradients": f"""
      SELECT item_id AS key, any_value(v) AS params, list(g ORDER BY d) AS grad FROM (
        SELECT item_id, d, any_value(i.vector) AS v,
          -sum((label - {dot('u.vector', 'i.vector')}) * u.vector[d] - {REG} * i.vector[d]) AS g
        FROM examples JOIN user_factors u USING (user_id) JOIN item_factors i USING (item_id), range(1, {DIM + 1}) r(d)
        GROUP BY item_id, d) GROUP BY item_id""",
}

_NAME = re.compile(r"[a-z_][a-z_0-9]*")


def with_ctes(body: str) -> str:
    """body with the CTEs it refers to, dependencies first."""
    order = []

    def visit(text):
        for name in _NAME.findall(text):
            if name in CTES and name not in order:
                visit(CTES[name]) if name not in _NAME.findall(CTES[name]) else visit(
                    re.sub(rf"\b{name}\b", "", CTES[name])
                )
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    return f"WITH {parts}\n{body}"


def unrolled(table, keys, vector, name="value"):
    """One row per element of a vector column."""
    return f"""SELECT {keys}, i - 1 AS i, {r6(f'{vector}[i]')} AS {name}
      FROM {table} t, unnest(range(1, len({vector}) + 1)) g(i)"""


def topk(queries, items, q, i, score, k, extra="true", out="score"):
    return f"SELECT {q}, {i}, {r6('score')} AS {out}, rank FROM ({top(queries, items, q, i, score, k, extra)})"


SURROGATE = (
    "substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,1,4) || '-' || substr(h,5,12)"
)
HEX = "[0-9a-fA-F]"
PLAIN = f"{HEX}{{8}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{12}}"
UUID = f"^({PLAIN}|{HEX}{{32}}|\\{{{PLAIN}\\}}|urn:uuid:{PLAIN})$"
CONTEXT = f"[hour(ts) / 24.0, (isodow(ts) - 1) / 7.0, {WEIGHT}, 0, 0, 0, 0, 0, 0, 0]::DOUBLE[]"
SIGNAL = (
    "list_concat(list_transform(['View', 'Click', 'Like', 'Share', 'Purchase', 'Convert'], "
    "lambda a: CASE WHEN a = action_type THEN 1.0 ELSE 0.0 END)::DOUBLE[], "
    "[hour(ts) / 24.0, (isodow(ts) - 1) / 7.0]::DOUBLE[], "
    f"list_transform(range(8, 128), lambda i: -1.0 + 2.0 * {draw('event_id::VARCHAR', 'i', 0)})::DOUBLE[])"
)
FUNNEL = """count(*) FILTER (action_type = 'View') AS impressions, count(*) FILTER (action_type = 'Click') AS clicks,
  count(*) FILTER (action_type IN ('Purchase', 'Convert')) AS conversions,
  count(*) FILTER (action_type <> 'View') AS engagements"""
RATES = f"""{r6('coalesce(clicks / nullif(impressions, 0)::DOUBLE, 0.0)')} AS click_through_rate,
  {r6('coalesce(conversions / nullif(clicks, 0)::DOUBLE, 0.0)')} AS conversion_rate,
  {r6('coalesce(engagements / nullif(impressions, 0)::DOUBLE, 0.0)')} AS engagement_rate"""

ORACLES = {}


def add(name, body):
    ORACLES[name] = with_ctes(body)


add("src_actions", "SELECT event_id, user_id, item_id, action_type, ts FROM actions")
add("src_dead_letters", "SELECT event_id, action_type AS variant FROM logged WHERE action_type = 'error'")
add("sink_actions_json", "SELECT user_id::VARCHAR AS record_key, user_id, item_id, action_type, ts FROM actions")
add(
    "topic_features",
    f"""SELECT user_id AS id, action_type, item_id, ts, {prints('v', 'vector')}
    FROM (SELECT *, ({SIGNAL})::FLOAT[]::DOUBLE[] AS v FROM actions)""",
)
add(
    "topic_training",
    f"""SELECT user_id, item_id, ts, weight AS label, 64::BIGINT AS user_dim, 10::BIGINT AS context_dim,
    {r6('list_sum(embedding)')} AS item_sum FROM weighted JOIN items USING (item_id)""",
)
add(
    "upsert_profiles",
    unrolled(
        """(SELECT * FROM late_profiles UNION ALL
        SELECT * FROM early_profiles WHERE user_id NOT IN (SELECT user_id FROM late_profiles))""",
        "user_id, interaction_count, last_updated",
        "embedding",
    ),
)
add(
    "upsert_items",
    unrolled(
        """(SELECT i.item_id, coalesce(lower(a.action_type), i.category) AS category,
          CASE WHEN a.weight IS NULL THEN i.embedding ELSE list_transform(i.embedding, lambda x: x * a.weight) END AS embedding
        FROM items i LEFT JOIN (SELECT * FROM weighted
          QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) = 1) a USING (item_id))""",
        "item_id, category",
        "embedding",
    ),
)
add(
    "update_embeddings",
    f"""SELECT item_id, category, {r6('popularity')} AS popularity, {prints('embedding', 'embedding')} FROM (
    SELECT item_id, category, popularity, CASE WHEN popularity > 0
      THEN list_transform(embedding, lambda x: x * popularity) ELSE embedding END AS embedding
    FROM items JOIN popularity USING (item_id))""",
)
add(
    "remove_vectors",
    """SELECT item_id, category FROM items
    WHERE item_id NOT IN (SELECT item_id FROM actions WHERE action_type = 'Purchase')""",
)
add(
    "lookup_profiles",
    f"""SELECT user_id, interaction_count, {prints('embedding', 'embedding')} FROM profiles
    WHERE user_id IN (SELECT o_custkey FROM orders)""",
)
add(
    "lookup_items",
    f"""SELECT item_id, category, {prints('embedding', 'embedding')} FROM items
    WHERE item_id IN (SELECT l_partkey FROM lineitem)""",
)
add(
    "latest_embeddings",
    f"""SELECT user_id, {prints('embedding', 'vector')} FROM weighted JOIN items USING (item_id)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
SNAPSHOT = """SELECT 'v1706659200' AS version, side, id, {p} FROM (
    SELECT 'user' AS side, user_id::VARCHAR AS id, {u} AS vector FROM {users}
    UNION ALL SELECT 'item', item_id::VARCHAR, vector FROM {items}
    UNION ALL SELECT 'bias', '', list_transform(range(64), lambda x: 0.0::DOUBLE))"""
add("model_snapshot", SNAPSHOT.format(p=prints("vector", "vector"), u="vector", users="step_users", items="step_items"))
add(
    "model_load",
    SNAPSHOT.format(
        p=prints("vector", "vector"), u="list_transform(vector, lambda x: x * 2)", users="user_factors", items="item_factors"
    ),
)
add("action_weight", f"SELECT event_id, action_type, {WEIGHT} AS weight FROM logged")
add(
    "context_features",
    f"""SELECT event_id, {r6('f[1]')} AS hour, {r6('f[2]')} AS weekday, {r6('f[3]')} AS strength, {prints('f', 'context')}
    FROM (SELECT event_id, {CONTEXT} AS f FROM actions)""",
)
add(
    "action_feature_vector",
    f"""SELECT event_id, user_id AS id, {', '.join(f"{r6(f'v[{n + 1}]')} AS f{n}" for n in range(8))},
    {prints('v', 'vector')} FROM (SELECT *, {SIGNAL} AS v FROM actions)""",
)
add(
    "parse_requests",
    f"""SELECT user_id, CASE WHEN user_id % 4 <> 0 THEN user_id % 7 ELSE 10 END::BIGINT AS num_recommendations,
    CASE WHEN user_id % 2 = 1 THEN concat_ws('|', 'c' || user_id % 10, 'c1', 'c' || user_id % 3) END AS filter_categories,
    CASE WHEN user_id % 3 <> 0 THEN concat_ws('|', s, 'urn:uuid:' || s, h) END AS exclude_items
    FROM (SELECT *, {SURROGATE} AS s FROM (SELECT user_id, md5(user_id::VARCHAR) AS h FROM people))""",
)
add(
    "validate_actions",
    """SELECT o_orderkey, CASE WHEN o_custkey = 0 THEN 'User ID cannot be nil'
    WHEN o_orderstatus = 'P' THEN 'Item ID cannot be nil'
    WHEN o_orderkey % 7 = 3 OR o_orderdate > TIMESTAMP '1998-06-01 01:00:00' THEN 'Timestamp cannot be more than 1 hour in the future'
    WHEN o_orderdate < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 365 DAY
      THEN 'Timestamp cannot be more than 1 year in the past' END AS error FROM orders""",
)
add("validate_profiles", f"SELECT vec_id, {vector_error('id', 'vector', 'User embedding')} END AS error FROM damaged")
add("validate_items", "SELECT vec_id, error FROM item_errors")
add(
    "validate_requests",
    """SELECT c_custkey, CASE WHEN c_custkey = 0 THEN 'User ID cannot be nil' ELSE CASE c_custkey % 9
    WHEN 0 THEN 'Number of recommendations must be greater than 0'
    WHEN 1 THEN 'Number of recommendations must be greater than 0'
    WHEN 2 THEN 'Number of recommendations too large (max 1000)'
    WHEN 3 THEN 'Filter categories cannot be empty if specified'
    WHEN 4 THEN 'Category name cannot be empty'
    WHEN 5 THEN 'Category name too long (max 100 characters)'
    WHEN 7 THEN 'Too many items to exclude (max 10000)'
    WHEN 8 THEN 'Excluded item ID cannot be nil' END END AS error FROM customer""",
)
add(
    "validate_examples",
    """SELECT event_id, CASE event_id % 12 WHEN 1 THEN 'User ID cannot be nil' WHEN 2 THEN 'Item ID cannot be nil'
    WHEN 0 THEN 'Training label contains invalid values (NaN or Infinity)'
    WHEN 3 THEN 'Training label contains invalid values (NaN or Infinity)'
    WHEN 4 THEN 'Training label must be between 0.0 and 1.0' WHEN 5 THEN 'User features cannot be empty'
    WHEN 6 THEN 'User features contain invalid values (NaN or Infinity)' WHEN 7 THEN 'Item features cannot be empty'
    WHEN 8 THEN 'Item features contain invalid values (NaN or Infinity)'
    WHEN 9 THEN 'Item features dimension too large (max 2048)'
    WHEN 10 THEN 'Context features contain invalid values (NaN or Infinity)'
    WHEN 11 THEN 'Context features dimension too large (max 512)' END AS error FROM examples""",
)
add(
    "validate_features",
    f"""SELECT vec_id, {vector_error('id', 'vector', 'Feature vector', 'Feature vector ID cannot be nil')} END AS error
    FROM damaged""",
)
add(
    "validate_model",
    f"""SELECT version, CASE min(n) WHEN 0 THEN 'Model version cannot be empty' WHEN 1 THEN 'Model version too long (max 100 characters)'
    WHEN 2 THEN 'User embedding weights cannot be empty' WHEN 3 THEN 'User embedding weights contain invalid values'
    WHEN 4 THEN 'Item embedding weights cannot be empty' WHEN 5 THEN 'Item embedding weights contain invalid values'
    WHEN 6 THEN 'Bias weights contain invalid values' END AS error
    FROM (SELECT CASE label WHEN 0 THEN '' WHEN 9 THEN repeat('v', 101) ELSE 'v' || label END AS version,
      CASE WHEN label = 0 THEN 0 WHEN label = 9 THEN 1
        WHEN coalesce(len(vector), 0) = 0 THEN CASE vec_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 END
        WHEN {broken('vector')} THEN CASE vec_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 6 END END AS n
      FROM damaged) GROUP BY version""",
)
add(
    "validate_dim",
    """SELECT vec_id, CASE WHEN coalesce(len(vector), 0) <> 64
    THEN 'Embedding dimension mismatch: expected 64, got ' || coalesce(len(vector), 0) END AS error FROM damaged""",
)
add("dq_summary", "SELECT coalesce(error, 'valid') AS rule, count(*) AS n FROM item_errors GROUP BY 1")
add(
    "actions_with_items",
    "SELECT event_id, user_id, item_id, category, weight FROM weighted JOIN items USING (item_id)",
)
add("user_profiles", unrolled("profiles", "user_id, interaction_count", "embedding"))
add("profiles_by_segments", unrolled("profiles", "user_id, interaction_count", "embedding"))
NUMBERED = """(SELECT w.*, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, embedding
    FROM weighted w JOIN items USING (item_id))"""
add(
    "profile_history",
    f"""SELECT any_value(a.event_id) AS event_id, any_value(a.user_id) AS user_id, any_value(a.item_id) AS item_id,
      any_value(a.weight) AS label, any_value(a.seq) AS interaction_count, i - 1 AS i,
      {r6('sum(0.1 * b.weight * pow(0.9, a.seq - b.seq) * b.embedding[i])')} AS value
    FROM {NUMBERED} a JOIN {NUMBERED} b ON a.user_id = b.user_id AND b.seq <= a.seq, range(1, {DIM + 1}) r(i)
    GROUP BY a.event_id, i""",
)
HISTORY_PRINTS = with_ctes(
    f"""SELECT any_value(a.event_id) AS event_id, any_value(a.user_id) AS user_id, any_value(a.item_id) AS item_id,
      any_value(a.weight) AS label, any_value(a.seq) AS interaction_count, 64::BIGINT AS embedding_n,
      {r6('sum(0.1 * b.weight * pow(0.9, a.seq - b.seq) * b.s)')} AS embedding_sum,
      {r6('sum(0.1 * b.weight * pow(0.9, a.seq - b.seq) * b.m)')} AS embedding_moment
    FROM numbered a JOIN numbered b ON a.user_id = b.user_id AND b.seq <= a.seq GROUP BY a.event_id""".replace(
        "numbered",
        """(SELECT w.*, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, list_sum(embedding) AS s,
          list_sum(list_transform(embedding, lambda x, i: x * i)) AS m FROM weighted w JOIN items USING (item_id))""",
    )
)
add(
    "get_or_create_profiles",
    f"""SELECT user_id, interaction_count, created, {prints('embedding', 'embedding')} FROM (
    SELECT c_custkey AS user_id, coalesce(interaction_count, 0) AS interaction_count, embedding IS NULL AS created,
      coalesce(embedding, list_transform(range(64), lambda x: 0.0::DOUBLE)) AS embedding
    FROM customer LEFT JOIN profiles ON user_id = c_custkey)""",
)
add(
    "build_training_examples",
    f"""SELECT event_id, user_id, item_id, label, ts, {prints('u', '"user"').replace('"user"', 'user')},
      {prints('v', 'item')}, {prints('c', 'context')} FROM (
    SELECT event_id, w.user_id, item_id, weight AS label, ts, i.embedding AS v, {CONTEXT} AS c,
      coalesce(p.embedding, list_transform(range(64), lambda x: 0.0::DOUBLE)) AS u
    FROM weighted w JOIN items i USING (item_id) LEFT JOIN early_profiles p ON p.user_id = w.user_id)""",
)
add(
    "build_training_examples_post",
    f"""SELECT event_id, h.user_id, item_id, label, ts, 64::BIGINT AS user_n, embedding_sum AS user_sum,
      embedding_moment AS user_moment, {prints('i.embedding', 'item')}, {prints('c', 'context')}
    FROM ({HISTORY_PRINTS}) h
    JOIN (SELECT event_id, ts, {CONTEXT} AS c FROM actions) USING (event_id) JOIN items i USING (item_id)""",
)
add("predict_pairs", f"SELECT user_id, item_id, {r6('score')} AS score FROM pair_scores")
add(
    "reason_text",
    """SELECT user_id, item_id, printf('Similar to your preferences (score: %.3f)', round(score, 3) + 0.0) AS reason
    FROM pair_scores""",
)
add(
    "recommend",
    f"""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY round(final, 9) DESC, rank) AS rank, item_id,
      {r6('final')} AS score, printf('Similar to your preferences (score: %.3f)', round(final, 3) + 0.0) AS reason, category
    FROM (SELECT c.*, (score + flat) / 2 AS final, category FROM plain_candidates c JOIN items USING (item_id)
      WHERE rank <= 3)""",
)
add(
    "recommend_batch",
    f"""SELECT user_id, rank, item_id, {r6('score')} AS score, category,
    printf('Similar to your preferences (score: %.3f)', round(score, 3)) AS reason FROM recs""",
)
add(
    "recommend_prefiltered",
    f"""SELECT user_id, item_id, {r6('final')} AS score, category,
      printf('Similar to your preferences (score: %.3f)', round(final, 3)) AS reason,
      row_number() OVER (PARTITION BY user_id ORDER BY round(final, 9) DESC, place) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS turn FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS place FROM (
          SELECT r.user_id, i.item_id, i.category, coalesce({cos('p.embedding', 'i.embedding')}, 0.0) AS score,
            coalesce(({cos('p.embedding', 'i.embedding')} + {dot('p.embedding', 'i.embedding')}) / 2, 0.0) AS final
          FROM requests r LEFT JOIN profiles p USING (user_id), items i
          WHERE (gone IS NULL OR NOT list_contains(gone, i.item_id)) AND (cats IS NULL OR list_contains(cats, i.category)))
        QUALIFY place <= 20) WHERE final >= 0.2) WHERE turn <= 10""",
)
add(
    "explain_recommendations",
    f"""SELECT user_id, rank, item_id, CASE
      WHEN alike > 0.8 THEN 'Highly recommended based on your preferences in ' || category || ' category'
      WHEN alike > 0.6 THEN 'Recommended because you like similar ' || category || ' items'
      WHEN popularity > 0.8 THEN 'Popular ' || category || ' item that might interest you'
      ELSE 'Recommended to help you discover new ' || category || ' content' END AS explanation FROM (
      SELECT r.user_id, r.rank, r.item_id, i.category, popularity, round({cos('p.embedding', 'i.embedding')}, 9) AS alike
      FROM recs r JOIN items i USING (item_id) JOIN popularity USING (item_id) JOIN profiles p USING (user_id))
    UNION ALL SELECT c_custkey + 1000000, 1, c_custkey, 'Recommended based on general popularity' FROM customer""",
)
add("topk_items_for_users", topk("profiles", "items", "user_id", "item_id", cos("q.embedding", "v.embedding"), 10))
add(
    "topk_cosine",
    topk("(SELECT item_id AS query, embedding FROM items)", "items", "query", "item_id", cos("q.embedding", "v.embedding"), 5),
)
add(
    "topk_l2",
    f"""SELECT user_id, item_id, {r6('-score')} AS distance, rank FROM (
    {top("profiles", "items", "user_id", "item_id", "-pow(list_distance(q.embedding, v.embedding), 2)", 10)})""",
)
add(
    "similar_users",
    topk(
        "profiles", "(SELECT user_id AS other_id, embedding FROM profiles)", "user_id", "other_id",
        cos("q.embedding", "v.embedding"), 5, "q.user_id <> v.other_id",
    ),
)
add(
    "similar_items",
    topk(
        "(SELECT * FROM items WHERE item_id IN (SELECT p_partkey FROM part))",
        "(SELECT item_id AS other_id, embedding FROM items)", "item_id", "other_id",
        cos("q.embedding", "v.embedding"), 5, "q.item_id <> v.other_id",
    ),
)
add(
    "recommend_unseen",
    topk(
        "profiles", "items", "user_id", "item_id", dot("q.embedding", "v.embedding"), 5,
        "(q.user_id, v.item_id) NOT IN (SELECT (user_id, item_id) FROM actions)",
    ) + " WHERE score > 0.05",
)
TREND = """SELECT row_number() OVER (ORDER BY round(score, 9) DESC, item_id) AS rank, item_id, {s} AS score,
    'Trending item' AS reason, category FROM trends"""
add("trending_items", TREND.format(s=r6("score")) + " QUALIFY rank <= 20")
add("trending_incremental", TREND.format(s=r6("score")) + " QUALIFY rank <= 20")
add("trending_in_category", TREND.format(s=r6("score")) + " WHERE category = 'c3' QUALIFY rank <= 5")
add(
    "personalized_trending",
    f"""SELECT user_id, rank, item_id, {r6('score')} AS score,
      printf('Personalized trending (score: %.3f)', round(score, 3) + 0.0) AS reason, category
    FROM ({top("early_profiles", "items", "user_id", "item_id", cos("q.embedding", "v.embedding"), 5)}) JOIN items USING (item_id)
    UNION ALL SELECT user_id, t.rank, t.item_id, t.score, t.reason, t.category
    FROM (SELECT user_id FROM people UNION SELECT c_custkey + 1000000 FROM customer) n,
      ({TREND.format(s=r6("score"))} QUALIFY rank <= 5) t
    WHERE user_id NOT IN (SELECT user_id FROM early_profiles)""",
)
add(
    "interval_join",
    """SELECT a.event_id, a.user_id, a.item_id, a.action_type, a.ts, f.ts AS matched_at, f.event_id AS feature_id
    FROM actions a JOIN actions f ON a.user_id = f.user_id AND f.ts <= a.ts AND f.ts >= a.ts - INTERVAL 1 DAY
    WHERE a.action_type IN ('Purchase', 'Convert') AND f.action_type NOT IN ('Purchase', 'Convert')
    QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY f.ts DESC, f.event_id DESC) = 1""",
)
add(
    "interval_join_ties",
    """SELECT a.event_id, a.user_id, a.item_id, a.action_type, a.ts, f.ts AS matched_at, f.event_id AS feature_id
    FROM (SELECT * REPLACE (date_trunc('day', ts)::TIMESTAMP AS ts) FROM actions) a
    JOIN (SELECT * REPLACE (date_trunc('day', ts)::TIMESTAMP AS ts) FROM actions) f
      ON a.user_id = f.user_id AND f.ts <= a.ts AND f.ts >= a.ts - INTERVAL 1 DAY
    WHERE a.action_type IN ('Purchase', 'Convert') AND f.action_type NOT IN ('Purchase', 'Convert')
    QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY f.ts DESC, f.event_id DESC) = 1""",
)
add("dead_features", "SELECT event_id FROM actions WHERE event_id % 5 <> 0")
add("dead_training", "SELECT event_id FROM actions WHERE event_id % 9 <> 0")
add("ann_topk", topk("profiles", "items", "user_id", "item_id", cos("q.embedding", "v.embedding"), 10))
CLUSTERED = f"""(SELECT v.item_id, list_transform(range(1, {DIM + 1}),
    lambda d: 2 * c.embedding[d] / {norm('c.embedding')} + v.embedding[d] / {norm('v.embedding')}) AS embedding
  FROM items v JOIN items c ON c.item_id = v.item_id % 25)"""
add(
    "ann_pq_topk",
    topk(f"(SELECT item_id AS query, embedding FROM {CLUSTERED})", CLUSTERED, "query", "item_id", cos("q.embedding", "v.embedding"), 10),
)
LOUD = "(SELECT item_id, list_transform(embedding, lambda x: x * ((item_id % 8 + 1) / 8)) AS embedding FROM items)"
NEW_PAIR = "(q.user_id, v.item_id) NOT IN (SELECT (user_id, item_id) FROM actions)"
add("bounded_topk", topk("profiles", LOUD, "user_id", "item_id", dot("q.embedding", "v.embedding"), 5, NEW_PAIR) + " WHERE score > 0.03")
add(
    "bounded_unseen",
    topk("profiles", "items", "user_id", "item_id", dot("q.embedding", "v.embedding"), 5, NEW_PAIR) + " WHERE score > 0.05",
)
REACH = f"floor(log2({norm('v.embedding')}) * 8) + 1 >= log2(0.03 / {norm('q.embedding')}) * 8 - 0.000001"
add(
    "bounded_pairs",
    f"""SELECT count(*)::BIGINT AS pairs, (count(*) FILTER ({REACH}))::BIGINT AS compared FROM profiles q, {LOUD} v
    WHERE {norm('v.embedding')} > 0 AND {norm('q.embedding')} > 0""",
)
add(
    "similar_items_all",
    topk(
        "items", "(SELECT item_id AS other_id, embedding FROM items)", "item_id", "other_id",
        cos("q.embedding", "v.embedding"), 5, "q.item_id <> v.other_id",
    ),
)
add("ann_recall", "SELECT count(*) AS n_queries, true AS enough FROM profiles")
SOUND = f"(SELECT vec_id, vector AS embedding FROM damaged WHERE coalesce(len(vector), 0) > 0 AND NOT {broken('vector')})"
add(
    "topk_dirty",
    topk(
        f"(SELECT vec_id AS query, embedding FROM {SOUND})", f"(SELECT vec_id AS item_id, embedding FROM {SOUND})", "query",
        "item_id", cos("q.embedding", "v.embedding"), 3, "len(q.embedding) = len(v.embedding)",
    ),
)
BOUGHT = """(SELECT DISTINCT o_custkey + 5000000000 AS user_id, l_partkey + 5000000000 AS item_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
add(
    "als_recommend",
    f"SELECT user_id, rank, true AS known, true AS falling FROM (SELECT DISTINCT user_id FROM {BOUGHT}), range(1, 6) r(rank)",
)
add("als_fit", f"SELECT count(*) AS n, true AS better FROM {BOUGHT}")
add(
    "weighted_average",
    f"""SELECT user_id, i - 1 AS i, {r6('sum(weight * embedding[i]) / sum(weight)')} AS value
    FROM weighted JOIN items USING (item_id), range(1, 65) r(i) WHERE action_type <> 'View' GROUP BY user_id, i""",
)
add(
    "mf_loss",
    f"""SELECT {r6(f"coalesce(avg(pow(label - {dot('u.vector', 'i.vector')}, 2)), 0.0)")} AS loss, count(*) AS n
    FROM examples JOIN user_factors u USING (user_id) JOIN item_factors i USING (item_id)""",
)
add(
    "online_metrics",
    f"""SELECT {RATES}, (SELECT {r6('avg(duration_seconds)')} FROM visits) AS session_length,
    (SELECT {r6('count(*) FILTER (bounced) / count(*)::DOUBLE')} FROM visits) AS bounce_rate
    FROM (SELECT {FUNNEL} FROM actions)""",
)
add(
    "online_metrics_windowed",
    f"""SELECT window_start, impressions, clicks, conversions, {RATES}
    FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, {FUNNEL} FROM actions GROUP BY 1)""",
)
add(
    "sessions",
    f"SELECT user_id, started, ended, n_events, {r6('duration_seconds')} AS duration_seconds, bounced FROM visits",
)
add(
    "sessions_windowed",
    f"SELECT user_id, started, ended, n_events, {r6('duration_seconds')} AS duration_seconds, bounced FROM visits",
)
add("init_orthogonal_gram", "SELECT i, j, (i = j)::INT::DOUBLE AS value FROM range(16) a(i), range(16) b(j)")
add(
    "serving_stats",
    """UNPIVOT (SELECT count(*) AS total_requests, count(*) FILTER (event_type <> 'error') AS successful_requests,
    count(*) FILTER (event_type = 'error') AS failed_requests, floor(avg(floor(value)))::BIGINT AS avg_latency_ms,
    max(floor(value))::BIGINT AS max_latency_ms FROM events)
    ON total_requests, successful_requests, failed_requests, avg_latency_ms, max_latency_ms INTO NAME stat VALUE value""",
)
add(
    "training_stats",
    """SELECT 'user_embeddings_count' AS stat, count(*) AS value FROM people
    UNION ALL SELECT 'item_embeddings_count', count(*) FROM items
    UNION ALL SELECT 'training_buffer_size', count(*) FROM examples UNION ALL SELECT 'last_model_save', 1706659200""",
)
add(
    "embedding_stats",
    f"""SELECT vec_id AS item_id, {r6('avg(x::DOUBLE)')} AS mean, {r6('var_pop(x::DOUBLE)')} AS variance
    FROM embeddings, unnest(embedding) u(x) GROUP BY vec_id""",
)
add(
    "precision_recall_at_k",
    f"""SELECT user_id, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1 FROM precision_recall""",
)
add("ndcg_at_k", f"SELECT user_id, {r6('ndcg')} AS ndcg FROM ndcg")
add("map_at_k", f"SELECT {r6('avg(ap)')} AS map FROM ap")
add("coverage", f"SELECT {r6('coverage')} AS coverage FROM covered")
add("intra_list_diversity", f"SELECT user_id, {r6('diversity')} AS diversity FROM list_diversity")
add(
    "category_diversity",
    f"""SELECT user_id, {r6('coalesce(d, 0.0)')} AS category_diversity FROM people LEFT JOIN (
    SELECT r.user_id, CASE WHEN count(*) <= 1 THEN 0.0
      ELSE count(DISTINCT i.category) / nullif(count(i.category), 0)::DOUBLE END AS d
    FROM recs r LEFT JOIN items i USING (item_id) GROUP BY r.user_id) USING (user_id)""",
)
add("novelty", f"SELECT user_id, {r6('novelty')} AS novelty FROM list_novelty")
add(
    "all_metrics",
    f"""SELECT {r6('avg(precision)')} AS precision_at_k, {r6('avg(recall)')} AS recall_at_k, {r6('avg(f1)')} AS f1_score,
      {r6('avg(ndcg)')} AS ndcg_at_k, {r6('avg(ap)')} AS map_score, {r6('avg(diversity)')} AS diversity,
      {r6('avg(novelty)')} AS novelty, (SELECT {r6('coverage')} FROM covered) AS coverage
    FROM precision_recall JOIN relevant_ndcg USING (user_id) JOIN ap USING (user_id)
    JOIN list_diversity USING (user_id) JOIN list_novelty USING (user_id)""",
)
add("vec_cosine", f"SELECT vec_id, {r6(f"(CASE WHEN len(a) <> len(b) THEN 0.0 ELSE {cos('a', 'b')} END)")} AS value FROM neighbours")
add(
    "vec_euclidean",
    f"""SELECT vec_id, len(a) <> len(b) AS infinite, CASE WHEN len(a) = len(b) THEN {r6('list_distance(a, b)')} END AS value
    FROM neighbours""",
)
add(
    "vec_manhattan",
    f"""SELECT vec_id, len(a) <> len(b) AS infinite, CASE WHEN len(a) = len(b)
      THEN {r6('list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2])))')} END AS value FROM neighbours""",
)
add("vec_dot", f"SELECT vec_id, {r6(dot('a', 'b'))} AS value FROM neighbours WHERE len(a) = len(b)")
add(
    "vec_normalize",
    f"""SELECT vec_id, i - 1 AS i, {r6("(CASE WHEN label = 1 THEN 0.0 ELSE embedding[i]::DOUBLE / " + norm("embedding::DOUBLE[]") + " END)")} AS value
    FROM embeddings, range(1, 65) r(i)""",
)
add(
    "activations",
    f"""SELECT event_id, {r6('1 / (1 + exp(-(value / 100 - 1)))')} AS sigmoid,
    {r6("(CASE WHEN event_type = 'view' THEN 0.0 ELSE greatest(value / 100 - 1, 0.0) END)")} AS relu FROM events""",
)
add(
    "softmax",
    f"""SELECT item_id, i - 1 AS i, {r6('exp(embedding[i]) / list_sum(list_transform(embedding, lambda x: exp(x)))')} AS value
    FROM items, range(1, 65) r(i)""",
)
add(
    "softmax_grouped",
    f"""SELECT event_id, {r6('exp(value / 100 - max(value / 100) OVER w) / sum(exp(value / 100 - m)) OVER w')} AS softmax
    FROM (SELECT *, max(value / 100) OVER (PARTITION BY user_id) AS m FROM events) WINDOW w AS (PARTITION BY user_id)""",
)
add(
    "decay_weight",
    f"SELECT event_id, {r6(f'exp(-0.01 * trunc((epoch_us({AS_OF}) - epoch_us(ts)) / 1e6) / 3600.0)')} AS weight FROM events",
)
add("surrogate_id", f"SELECT c_custkey, {SURROGATE} AS id FROM (SELECT c_custkey, md5(c_name) AS h FROM customer)")
add(
    "sanitize_text",
    r"""SELECT doc_id, clean, length(clean) AS n FROM
    (SELECT doc_id, regexp_replace(text, '[^\p{L}\p{M}\p{N}\s\-_.,!?]', '', 'g') AS clean FROM documents)""",
)
add(
    "validate_uuid",
    f"""SELECT c_custkey, regexp_matches(t, '{UUID}') AS valid FROM (
    SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN s WHEN 1 THEN h WHEN 2 THEN '{{' || upper(s) || '}}'
      WHEN 3 THEN 'urn:uuid:' || s WHEN 4 THEN s || '0' ELSE c_name END AS t
    FROM (SELECT *, {SURROGATE} AS s FROM (SELECT c_custkey, c_name, md5(c_name) AS h FROM customer)))""",
)
add(
    "topk_indices",
    """SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY embedding[i] DESC, i) - 1 AS place, i - 1 AS idx
    FROM embeddings, range(1, 65) r(i) QUALIFY place < 3""",
)
add("batch_scores", f"SELECT item_id, {r6(norm('embedding'))} AS length FROM items")
add(
    "mf_sgd_step",
    f"""SELECT 'user' AS side, * FROM ({unrolled('step_users', 'user_id AS id', 'vector')})
    UNION ALL SELECT 'item', * FROM ({unrolled('step_items', 'item_id', 'vector')})""",
)
add(
    "mf_train",
    f"""SELECT 'user' AS side, * FROM ({unrolled('train2_users', 'user_id AS id', 'vector')})
    UNION ALL SELECT 'item', * FROM ({unrolled('train2_items', 'item_id', 'vector')})""",
)
add(
    "factors_or_init",
    unrolled(
        f"""(SELECT c_custkey AS item_id, coalesce(vector, {init_list('xavier_uniform', 'c_custkey', DIM, 0)}) AS vector
        FROM customer LEFT JOIN item_factors ON item_id = c_custkey)""",
        "item_id",
        "vector",
    ),
)
add(
    "negative_samples",
    """SELECT e.event_id, e.user_id, u.item_id, d AS draw
    FROM (SELECT *, ('0x' || substr(md5(event_id || ':pick0'), 1, 15))::UBIGINT AS start FROM examples WHERE label > 0.5) e
    JOIN (SELECT user_id, item_id,
        row_number() OVER (PARTITION BY user_id ORDER BY md5(item_id || ':dense0'), item_id) - 1 AS place,
        count(*) OVER (PARTITION BY user_id) AS n
      FROM (SELECT DISTINCT user_id FROM examples), items i
      WHERE (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM examples)) u
    ON u.user_id = e.user_id, range(1, 5) r(d)
    WHERE d <= u.n AND u.place = (e.start + d - 1) % u.n""",
)
add(
    "negative_samples_synthetic",
    f"""SELECT event_id, user_id, name AS item_id, 0.0::DOUBLE AS label, ts, {prints('v', 'item')} FROM (
    SELECT *, {init_list('xavier_uniform', 'name', DIM, 0)} AS v FROM (
      SELECT *, md5(event_id || ':' || d || ':item0') AS name FROM examples, range(1, 5) r(d) WHERE label > 0.5))""",
)


def _optimizer(element, state):
    """Two steps on one element: element(p, g, states, t) -> (p', states')."""
    p, g, s = "params[i]", "grad[i]", state
    for t in (1, 2):
        p, s = element(p, g, s, t)
    return f"""SELECT key, i - 1 AS i, {r6(f'({p})')} AS value FROM item_gradients, range(1, {DIM + 1}) r(i)"""


def _sgd(p, g, s, t):
    return f"({p} - 0.01 * {g})", s


def _adam(p, g, s, t):
    m, v = f"(0.9 * {s[0]} + 0.1 * {g})", f"(0.999 * {s[1]} + 0.001 * {g} * {g})"
    up = f"({m} / (1 - pow(0.9, {t}))) * 0.001 / sqrt({v} / (1 - pow(0.999, {t})) + 1e-8)"
    return f"({p} - {up})", (m, v)


def _adagrad(p, g, s, t):
    total = f"({s[0]} + {g} * {g})"
    return f"({p} - {g} * 0.01 / sqrt({total} + 1e-8))", (total,)


def _rmsprop(p, g, s, t):
    mean = f"(0.9 * {s[0]} + 0.1 * {g} * {g})"
    return f"({p} - {g} * 0.001 / sqrt({mean} + 1e-8))", (mean,)


for _name, _element, _state in (
    ("sgd", _sgd, ()),
    ("adam", _adam, ("0.0", "0.0")),
    ("adagrad", _adagrad, ("0.0",)),
    ("rmsprop", _rmsprop, ("0.0",)),
):
    add(f"opt_{_name}", _optimizer(_element, _state))

for _method, _params in INITS.items():
    _element = init_element(_method, "vec_id::VARCHAR", "i", DIM, 11, **_params)
    add(f"init_{_method}", f"SELECT vec_id AS item_id, i, {r6(_element)} AS value FROM embeddings, range(0, {DIM}) r(i)")
