"""Queries of masks, sensitive data, logs and text ranking: documents, pages, customers, and log lines made of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import masking as K
from plumbline.operators import texts as X
from plumbline.sources import tables as S

from .inputs import EDGES, edges
from .registry import query


#: Contact columns made of customers: phone, id card, e-mail, bank card, name, ip.
CONTACTS = """contacts AS (SELECT c_custkey, '13' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS phone, lpad(CAST(c_custkey AS VARCHAR), 17, '1') || 'X' AS id_no, CASE WHEN c_custkey % 10 = 0 THEN 'none' ELSE 'u' || c_custkey || '@mail' || c_custkey % 3 || '.example.com' END AS email,
lpad(CAST(c_custkey AS VARCHAR), 16, '6') AS card, c_name AS name, '10.' || c_custkey % 200 || '.7.' || c_custkey % 90 AS ip FROM customer)"""


def contacts(spark, d):
    k = F.col("c_custkey").cast("string")
    n = F.col("c_custkey")
    return S.table(spark, d, "customer").select(
        "c_custkey",
        F.concat(F.lit("13"), F.lpad(k, 9, "0")).alias("phone"),
        F.concat(F.lpad(k, 17, "1"), F.lit("X")).alias("id_no"),
        F.when(n % 10 == 0, "none").otherwise(F.concat(F.lit("u"), k, F.lit("@mail"), (n % 3).cast("string"), F.lit(".example.com"))).alias("email"),
        F.lpad(k, 16, "6").alias("card"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("10."), (n % 200).cast("string"), F.lit(".7."), (n % 90).cast("string")).alias("ip"),
    )


@query("msk_preserve", f"""WITH {CONTACTS} SELECT c_custkey, substr(phone, 1, 3) || '****' || right(phone, 4) AS phone, substr(id_no, 1, 6) || '********' || right(id_no, 4) AS id_no, CASE WHEN email = 'none' THEN 'n***' ELSE 'u***@' || split_part(email, '@', 2) END AS email,
'**** **** **** ' || right(card, 4) AS card, 'C' || repeat('*', length(name) - 1) AS name, regexp_replace(ip, '(\\d+)\\.(\\d+)$', '*.*') AS ip FROM contacts""")
def msk_preserve(spark, d):
    return K.masked(contacts(spark, d), {"phone": "phone", "id_no": "id_card", "email": "email", "card": "bank_card", "name": "person_name", "ip": "ip_address"})


@query("msk_diff", f"""WITH {CONTACTS} SELECT c_custkey, substr(phone, 1, 3) || '****' || right(phone, 4) AS phone, substr(id_no, 1, 3) || repeat('*', length(id_no) - 7) || right(id_no, 4) AS id_no, CASE WHEN email = 'none' THEN '***' ELSE 'u***@m***.com' END AS email, '**** **** **** ' || right(card, 4) AS card, name, ip FROM contacts""")
def msk_diff(spark, d):
    return K.masked(contacts(spark, d), {"phone": "phone", "id_no": "id_number", "email": "email", "card": "credit_card"}, "report")


@query("msk_result", f"""WITH {CONTACTS} SELECT c_custkey, substr(phone, 1, 3) || '****' || right(phone, 2) AS phone, substr(id_no, 1, 4) || repeat('*', length(id_no) - 7) || right(id_no, 3) AS id_no, CASE WHEN email = 'none' THEN 'n**e' ELSE 'u***@' || split_part(email, '@', 2) END AS email,
substr(card, 1, 4) || repeat('*', length(card) - 8) || right(card, 4) AS card, substr(name, 1, 1) || repeat('*', length(name) - 2) || right(name, 1) AS name, ip FROM contacts""")
def msk_result(spark, d):
    return K.masked(contacts(spark, d), {"phone": "phone", "id_no": "id", "email": "email", "card": "bank", "name": "generic"}, "result")


@query("pii_by_value", f"""WITH {CONTACTS} SELECT 'phone' AS column_name, 'phone' AS category, CAST(1.0 AS DOUBLE) AS share FROM (SELECT count(*) AS n FROM contacts) WHERE n > 0 UNION ALL SELECT 'id_no', 'id_card', CAST(1.0 AS DOUBLE) UNION ALL
SELECT 'email', 'email', avg(CASE WHEN email <> 'none' THEN 1.0 ELSE 0.0 END) FROM contacts UNION ALL SELECT 'card', 'bank_card', CAST(1.0 AS DOUBLE)""")
def pii_by_value(spark, d):
    return K.pii_by_value(contacts(spark, d), ["phone", "id_no", "email", "card", "name"])


_NAMED = [("phone", "mobile_no", "", "phone", "high"), ("weak", "name", "", "person_name", "medium"), ("comment", "name_2", "收货人电话", "phone", "high"), ("strong", "user_name", "身份证", "person_name", "medium"), ("own", "badge", "", "badge", "low"), ("none", "amount", "", None, None), ("ip", "ip_addr", "", "ip_address", "low")]


@query("pii_by_name", "SELECT p_brand || '.' || kind AS table_name, column_name, category, severity FROM (SELECT DISTINCT p_brand FROM part), (VALUES " + ", ".join(f"('{k}', '{n}', '{c}', '{s}')" for k, n, _, c, s in _NAMED if c) + ") v(kind, column_name, category, severity)")
def pii_by_name(spark, d):
    """Seven columns for each brand: strong and weak names, words of comments, and a rule of one's own."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("column_name"), F.lit(c).alias("comment")) for k, n, c, _, _ in _NAMED])).alias("x")
    catalog = S.table(spark, d, "part").select("p_brand").distinct().select("p_brand", cells).select(F.concat_ws(".", "p_brand", "x.k").alias("table_name"), "x.column_name", "x.comment")
    return K.pii_by_name(catalog, [("badge", "low", "^badge$", "")])


@query("pii_any_value", " UNION ALL ".join(f"SELECT * FROM (SELECT 'text' AS column_name, '{k}' AS category, count(*) FILTER (regexp_matches(text, '{p}')) AS rows_hit, CAST(coalesce(sum(len(regexp_extract_all(text, '{p}'))), 0) AS BIGINT) AS occurrences FROM documents) WHERE rows_hit > 0" for k, p in K.INSIDE))
def pii_any_value(spark, d):
    return K.pii_inside(S.table(spark, d, "documents"), ["text"])


_COLUMN_EDGES = f"""{EDGES}, ce AS (SELECT src, dst, CASE WHEN CAST(substr(src, 2) AS BIGINT) % 4 = 3 THEN 'md5(x)' ELSE 'x' END AS expression FROM edges)"""


@query("pii_spread", f"""WITH RECURSIVE {_COLUMN_EDGES}, f(root, node, hop) AS (SELECT 'c' || c_custkey, 'c' || c_custkey, 0 FROM customer UNION SELECT root, dst, hop + 1 FROM f JOIN ce ON src = node WHERE hop < 5 AND expression <> 'md5(x)'), n AS (SELECT DISTINCT root, node FROM f WHERE hop < 5)
SELECT root AS src_column, 'phone' AS category, count(DISTINCT dst) AS reached, count(*) FILTER (expression = 'x') AS unmasked_edges FROM n JOIN ce ON src = node GROUP BY 1""")
def pii_spread(spark, d):
    """Every customer's column through the lineage that the keys draw; every fourth step hides the value."""
    masked = F.when(F.substring("src", 2, 20).cast("long") % 4 == 3, "md5(x)").otherwise("x")
    columns = S.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("column_name"), F.lit("phone").alias("category"))
    return K.pii_spread(edges(spark, d).select("src", "dst", masked.alias("expression")), columns)


#: Lines with every kind of secret, placeholders, an ignored line and plain ones, made of customers' keys.
_KEYS = "lpad(CAST(c_custkey AS VARCHAR), 8, '0')"
_LINES = [
    "id = AKIA{k}ABCDEFGH", "aws_secret_access_key = '{k}{k}{k}abcdEFGH/+=90123'", "token: ghp_{k}{k}{k}abcdefghijkl", "x glpat-{k}abcdef_-{k}", "slack xoxb-{k}-{k}", "LTAI{k}Abcd5678",
    "-----BEGIN RSA PRIVATE KEY----- {k}", "eyJhbGci{k}.eyJzdWIi{k}.sig{k}", "db_password = \"p{k}\"", "password: 'changeme{k}'", "api_key = 'k{k}abcd-EFGH.12'", "see postgres://user:pw{k}@host/db",
    "access_token: 'AKIA{k}ABCDEFGH'", "blob = 'q7Zp{k}XvB2mKtR9sLw'", "password = 'real{k}' # secretscan:ignore", "plain text of customer {k}",
]
SECRET_LINES = "sl AS (SELECT c_custkey, unnest([" + ", ".join("'" + x.replace("'", "''").replace("{k}", f"' || {_KEYS} || '") + "'" for x in _LINES) + f"]) AS x, unnest(range(1, {len(_LINES) + 1})) AS line FROM customer)"


#: Every document with one of these lines below it, by its id.
DOCUMENT_LINES = "sl AS (SELECT doc_id, unnest(p) AS x, unnest(range(1, len(p) + 1)) AS line FROM (SELECT doc_id, string_split_regex(coalesce(text, '') || chr(10) || [" + ", ".join("'" + x.replace("'", "''").replace("{k}", f"' || {_KEYS.replace('c_custkey', 'doc_id')} || '") + "'" for x in _LINES) + f"][doc_id % {len(_LINES)} + 1], '\\r\\n|[\\r\\n]') AS p FROM documents))"


def _secret_lines(key: str):
    k = F.lpad(F.col(key).cast("string"), 8, "0")
    lines = []
    for x in _LINES:
        parts = x.split("{k}")
        lines.append(F.concat(*[y for i, part in enumerate(parts) for y in ([F.lit(part)] if i == 0 else [k, F.lit(part)])]))
    return lines


def secret_texts(spark, d):
    lines = _secret_lines("c_custkey")
    return S.table(spark, d, "customer").select("c_custkey", F.concat_ws("\n", *lines).alias("text"))


def _sec_sql(lines=SECRET_LINES, key="c_custkey"):
    hits = []
    for rule, severity, p, group in K.SECRETS:
        pattern = p.replace("'", "''")
        value = f"regexp_extract(x, '{pattern}', {group})"
        bad = " OR ".join(f"contains(lower({value}), '{m}')" for m in K.PLACEHOLDERS)
        hits.append(f"SELECT {key}, line, x, '{rule}' AS rule, '{severity}' AS severity, {value} AS v FROM open WHERE regexp_matches(x, '{pattern}')" + (f" AND NOT ({bad})" if group else ""))
    entropy = K.ENTROPY_PATTERN.replace("'", "''")
    bad = " OR ".join(f"contains(lower(v), '{m}')" for m in K.PLACEHOLDERS)
    return f"""WITH {lines}, open AS (SELECT * FROM sl WHERE NOT contains(x, '{K.PRAGMA}')), h AS ({" UNION ALL ".join(hits)}), hi AS (SELECT DISTINCT {key}, line FROM h WHERE severity = 'high'),
kept AS (SELECT h.* FROM h LEFT JOIN hi ON h.{key} = hi.{key} AND h.line = hi.line WHERE NOT (hi.line IS NOT NULL AND rule IN ('apikey_assign', 'password_assign'))),
e AS (SELECT {key}, line, x, regexp_extract(x, '{entropy}', 1) AS v FROM open o WHERE regexp_matches(x, '{entropy}') AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.{key} = o.{key} AND k.line = o.line)),
c AS (SELECT {key}, line, v, ch, count(*) AS n FROM (SELECT {key}, line, v, unnest(string_split(v, '')) AS ch FROM e) GROUP BY ALL), s AS (SELECT {key}, line, v, -sum(n / length(v) * log2(n / length(v))) AS bits FROM c GROUP BY ALL),
r AS (SELECT {key}, line, 'high_entropy' AS rule, 'low' AS severity, v FROM s WHERE bits >= {K.ENTROPY_LEAST} AND CAST(regexp_matches(v, '[a-z]') AS INT) + CAST(regexp_matches(v, '[A-Z]') AS INT) + CAST(regexp_matches(v, '[0-9]') AS INT) >= 2 AND NOT ({bad}))
SELECT {key}, CAST(line AS INTEGER) AS line, rule, severity, CASE WHEN length(v) <= 8 THEN substr(v, 1, 2) || '…' ELSE substr(v, 1, 4) || '…' || right(v, 2) END AS masked FROM (SELECT {key}, line, rule, severity, v FROM kept UNION ALL SELECT * FROM r)"""


@query("sec_scan", _sec_sql())
def sec_scan(spark, d):
    """All rules on lines that hold every kind of secret."""
    return K.secret_lines(X.spread(secret_texts(spark, d)), "c_custkey")


@query("sec_documents", _sec_sql(DOCUMENT_LINES, "doc_id"))
def sec_documents(spark, d):
    """All rules on every line of the documents, each with a line below it that may hold a secret."""
    below = F.element_at(F.array(*_secret_lines("doc_id")), (F.col("doc_id") % len(_LINES) + 1).cast("int"))
    docs = S.table(spark, d, "documents").select("doc_id", F.concat_ws("\n", F.coalesce("text", F.lit("")), below).alias("text"))
    return K.secret_lines(X.spread(docs), "doc_id")


@query("sec_entropy", f"SELECT * FROM ({_sec_sql()}) WHERE rule = 'high_entropy'")
def sec_entropy(spark, d):
    """Random-looking assignments that no rule knows: entropy by higher-order functions."""
    return K.secret_lines(X.spread(secret_texts(spark, d)), "c_custkey").filter("rule = 'high_entropy'")


@query("agg_entropy", """WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch FROM part), n AS (SELECT p_partkey, ch, count(*) AS k FROM c GROUP BY 1, 2) SELECT p_partkey, round(-sum(k / total * log2(k / total)), 6) AS entropy FROM (SELECT *, sum(k) OVER (PARTITION BY p_partkey) AS total FROM n) GROUP BY 1""")
def agg_entropy(spark, d):
    return S.table(spark, d, "part").select("p_partkey", F.round(K.entropy(F.col("p_name")), 6).alias("entropy"))


def _message(sql: bool):
    if sql:
        return "'worker ' || user_id || ' at 10.0.' || user_id % 256 || '.1:8080 failed reading /data/in/part-' || event_id || '.csv after ' || CAST(floor(value) AS BIGINT) || ' ms'"
    s = lambda c: F.col(c).cast("string")
    return F.concat(F.lit("worker "), s("user_id"), F.lit(" at 10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".1:8080 failed reading /data/in/part-"), s("event_id"), F.lit(".csv after "), F.floor("value").cast("long").cast("string"), F.lit(" ms"))


@query("log_template", f"""SELECT event_type, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_message(True)}, '\\b\\d{{1,3}}(?:\\.\\d{{1,3}}){{3}}(?::\\d+)?\\b', '<ADDR>', 'g'), '(?:[\\\\/][\\w.$~-]+){{2,}}', '<PATH>', 'g'), '\\b\\d+\\b', '<N>', 'g'), '\\s+', ' ', 'g')) AS template, count(*) AS n FROM events GROUP BY ALL""")
def log_template(spark, d):
    return S.table(spark, d, "events").groupBy("event_type", X.template(_message(False)).alias("template")).agg(F.count(F.lit(1)).alias("n"))


#: Log lines made of events: an INFO line each, errors with an exception, a cause and frames that vary; one file a user.
def log_lines(spark, d):
    k, text = F.col("event_id"), lambda c: c.cast("string")
    e = S.table(spark, d, "events").withColumn("ts_text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    kind = F.concat(F.lit("com.app.Type"), text(k % 3), F.lit("Exception"))
    cause = F.concat(F.lit("Caused by: java.io.Kind"), text(k % 4), F.lit("Error: disk "), text(k), F.when(k % 2 == 0, " full").otherwise(" is gone"))
    frame = F.concat(F.lit("\tat com.app.Disk"), text(k % 2), F.lit(".write(Disk.java:"), text(k % 90), F.lit(")"))
    level = F.when(k % 5 == 0, " WARN").otherwise(" ERROR")
    head = F.concat("ts_text", level, F.lit(" [main] com.app.Job - task failed"))
    lines = F.when(
        F.col("event_type") == "error",
        F.when(k % 7 == 0, F.array(F.concat("ts_text", level, F.lit(" [main] com.app.Job - lost part "), text(k)))).otherwise(F.array(head, F.concat(kind, F.lit(": "), _message(False)), F.lit("\tat com.app.Job.run(Job.java:10)"), cause, frame)),
    ).otherwise(F.array(F.concat("ts_text", F.lit(" INFO state changed to ERROR for "), F.col("event_type"))))
    return e.select(F.concat(F.lit("user"), text(F.col("user_id") % 50)).alias("file"), "event_id", F.posexplode(lines).alias("i", "line")).select("file", (k * 10 + F.col("i")).alias("n"), "line")


_EVENTS = """ev AS (SELECT 'user' || user_id % 50 AS file, event_id * 10 AS first_line, CASE WHEN event_id % 5 = 0 THEN 'WARN' ELSE 'ERROR' END AS level, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'java.io.Kind' || event_id % 4 || 'Error' END AS exception,
CASE WHEN event_id % 7 = 0 THEN 'lost part ' || event_id ELSE 'disk ' || event_id || CASE WHEN event_id % 2 = 0 THEN ' full' ELSE ' is gone' END END AS message, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'com.app.Disk' || event_id % 2 || '.write' END AS frame FROM events WHERE event_type = 'error'),
et AS (SELECT *, regexp_replace(message, '\\b\\d+\\b', '<N>', 'g') AS template FROM ev), lc AS (SELECT exception, template, frame, min(level) AS level, count(*) AS n, count(DISTINCT file) AS files, min(ts) AS first_ts, max(ts) AS last_ts, min(message) AS sample FROM et GROUP BY 1, 2, 3)"""


@query("log_events", f"WITH {_EVENTS} SELECT * FROM et")
def log_events(spark, d):
    return X.log_events(log_lines(spark, d))


@query("log_cluster", f"WITH {_EVENTS} SELECT * FROM lc")
def log_cluster(spark, d):
    return X.log_clusters(X.log_events(log_lines(spark, d)))


KB = [(1, "disk_full", "high", "(?i)disk .* full"), (2, "memory", "high", "(?i)outofmemory"), (3, "io", "mid", "java.io.Kind[01]Error")]


@query("log_diagnose", f"WITH {_EVENTS} SELECT CASE WHEN template LIKE '%full' THEN 'disk_full' WHEN regexp_matches(exception, 'Kind[01]') THEN 'io' ELSE 'unknown' END AS problem, CASE WHEN template LIKE '%full' THEN 'high' WHEN regexp_matches(exception, 'Kind[01]') THEN 'mid' ELSE 'low' END AS severity, CAST(sum(n) AS BIGINT) AS n, count(*) AS clusters FROM lc GROUP BY 1, 2")
def log_diagnose(spark, d):
    kb = spark.createDataFrame(KB, "rank int, problem string, severity string, pattern string")
    return X.diagnose(X.log_clusters(X.log_events(log_lines(spark, d))), kb)


_ERR = "e AS (SELECT user_id % 50 AS k, event_id, event_type FROM events WHERE event_type = 'error')"


@query("log_run_diff", """WITH o AS (SELECT user_id AS k, count(*) AS n_old FROM events WHERE event_type = 'error' AND event_id % 2 = 0 GROUP BY 1), w AS (SELECT user_id AS k, count(*) AS n_new FROM events WHERE event_type = 'error' AND event_id % 2 = 1 GROUP BY 1)
SELECT * FROM (SELECT k, n_old, n_new, CASE WHEN n_old IS NULL THEN 'appeared' WHEN n_new IS NULL THEN 'gone' WHEN n_new >= greatest(2 * n_old, n_old + 1) THEN 'grew' END AS change FROM o FULL JOIN w USING (k)) WHERE change IS NOT NULL""")
def log_run_diff(spark, d):
    e = S.table(spark, d, "events").filter("event_type = 'error'").withColumnRenamed("user_id", "k")
    old, new = (e.filter(F.col("event_id") % 2 == i).groupBy("k").agg(F.count(F.lit(1)).alias("n")) for i in (0, 1))
    return X.run_diff(old, new, ["k"])


_RUNS = "r AS (SELECT 'wf' || user_id % 20 AS workflow, event_id AS run_number, event_id // 3 AS sha, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS conclusion, value AS duration FROM events)"


def ci_runs(spark, d):
    return S.table(spark, d, "events").select(F.concat(F.lit("wf"), (F.col("user_id") % 20).cast("string")).alias("workflow"), F.col("event_id").alias("run_number"), F.floor(F.col("event_id") / 3).alias("sha"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("conclusion"), F.col("value").alias("duration"))


@query("log_ci", f"WITH {_RUNS} SELECT workflow, sha FROM r GROUP BY 1, 2 HAVING max(CASE WHEN conclusion = 'success' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN conclusion = 'failure' THEN 1 ELSE 0 END) = 1")
def log_ci(spark, d):
    return X.ci_flaky(ci_runs(spark, d))


@query("log_ci_drift", f"WITH {_RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY run_number DESC) AS rn FROM r), g AS (SELECT workflow, max(duration) FILTER (rn = 1) AS latest, median(duration) FILTER (rn > 1) AS median_before, count(*) FILTER (rn > 1) AS n FROM k GROUP BY 1) SELECT workflow, latest, median_before, n >= 3 AND latest > 1.5 * median_before AS drifted FROM g")
def log_ci_drift(spark, d):
    return X.ci_drift(ci_runs(spark, d))


_POST = "w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)')) AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS tf FROM w GROUP BY 1, 2), len AS (SELECT doc_id, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)')) AS BIGINT) AS length FROM documents)"


@query("txt_tokens", f"WITH {_POST} SELECT doc_id, length AS n_tokens FROM len")
def txt_tokens(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.size(X.tokens(F.coalesce("text", F.lit("")))).cast("long").alias("n_tokens"))


#: Queries are the whole texts of the documents whose id is divisible by 100.
_BM = f"""{_POST}, q AS (SELECT DISTINCT doc_id AS query_id, term FROM p WHERE doc_id % 100 = 0), st AS (SELECT count(*) AS n, avg(length) AS mean FROM len), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score, count(*) AS terms FROM q JOIN p USING (term) JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY 1, 2)"""


def asked(spark, d):
    return S.table(spark, d, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


@query("txt_bm25", f"WITH {_BM} SELECT query_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10")
def txt_bm25(spark, d):
    postings, lengths = X.inverted_index(S.table(spark, d, "documents"), "doc_id")
    return X.bm25(asked(spark, d), postings, lengths, "doc_id", 10)


@query("txt_near_dup")
def txt_near_dup(spark, d):
    """All documents; held against brute force in the tests."""
    return X.near_duplicates(S.table(spark, d, "documents"), "doc_id")


_COS = """e AS (SELECT vec_id, embedding FROM embeddings), vq AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(embedding, qe), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(qe, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 5) AS score FROM e, vq)"""


@query("txt_vector", f"WITH {_COS} SELECT query_id, vec_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM c) WHERE rank <= 10")
def txt_vector(spark, d):
    """Exact cosine of all vectors against those whose id is divisible by 100."""
    e = S.table(spark, d, "embeddings")
    return X.top_cosine(e, e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), "vec_id", "embedding")


@query("txt_hybrid", f"""WITH {_BM}, {_COS.replace("vec_id", "doc_id").replace("doc_id AS query_id", "vec_id AS query_id").replace("SELECT doc_id, embedding FROM", "SELECT vec_id AS doc_id, embedding FROM").replace("WHERE doc_id %", "WHERE vec_id %")}, v AS (SELECT query_id, doc_id, score FROM c),
u AS (SELECT query_id, doc_id, score / nullif(max(score) OVER (PARTITION BY query_id), 0) * 0.3 AS part FROM s UNION ALL SELECT query_id, doc_id, terms / nullif(max(terms) OVER (PARTITION BY query_id), 0) * 0.4 FROM s UNION ALL SELECT query_id, doc_id, score / nullif(max(score) OVER (PARTITION BY query_id), 0) * 0.3 FROM v),
f AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM u GROUP BY 1, 2)
SELECT query_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f) WHERE rank <= 10""")
def txt_hybrid(spark, d):
    """Keyword, BM25 and vector scores, all of them, of each query, where an embedding's id is that of its document."""
    postings, lengths = X.inverted_index(S.table(spark, d, "documents"), "doc_id")
    e = S.table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    own = e.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return X.hybrid(asked(spark, d), postings, lengths, e, own, "doc_id", "embedding", {"bm25": 0.3, "keyword": 0.4, "vector": 0.3})


@query("txt_asset_search", """SELECT p_name AS table_name, CAST(max(CASE WHEN contains(p_name, 'widget') THEN 5 ELSE 0 END) + max(CASE WHEN contains(lower(p_type), 'economy') THEN 4 ELSE 0 END) + max(CASE WHEN contains(p_name, 'red') THEN 5 ELSE 0 END) AS BIGINT) AS score FROM part GROUP BY 1 HAVING score > 0""")
def txt_asset_search(spark, d):
    parts = S.table(spark, d, "part").select(F.col("p_name").alias("table_name"), F.col("p_type").alias("table_comment"), F.lit("").alias("column_name"), F.lit("").alias("column_comment"))
    return X.search_catalog(parts, ["widget", "economy", "red"]).withColumn("score", F.col("score").cast("long"))


@query("txt_value_hits", """WITH q AS (SELECT * FROM (VALUES (1, 'how many building customers, not buildings'), (2, 'machinery: share of orders'), (3, 'household''s and autos')) v(query_id, query) UNION ALL SELECT 100 + p_partkey, 'parts like ' || p_name || ' for ' || p_type FROM part),
w AS (SELECT query_id, ' ' || array_to_string(regexp_extract_all(lower(query), '[a-z0-9_]+'), ' ') || ' ' AS line FROM q), i AS (SELECT DISTINCT 'c_mktsegment' AS column_name, c_mktsegment AS v FROM customer UNION SELECT DISTINCT 'p_type', p_type FROM part UNION SELECT DISTINCT 'p_brand', p_brand FROM part)
SELECT CAST(query_id AS BIGINT) AS query_id, column_name, v FROM w JOIN i ON contains(line, ' ' || array_to_string(regexp_extract_all(lower(v), '[a-z0-9_]+'), ' ') || ' ')""")
def txt_value_hits(spark, d):
    """A few questions and one for each part, against the values of three columns."""
    few = spark.createDataFrame([(1, "how many building customers, not buildings"), (2, "machinery: share of orders"), (3, "household's and autos")], "query_id long, query string")
    part, customer = S.table(spark, d, "part"), S.table(spark, d, "customer")
    each = part.select((F.col("p_partkey") + 100).alias("query_id"), F.concat(F.lit("parts like "), "p_name", F.lit(" for "), "p_type").alias("query"))
    values = [t.select(F.lit(c).alias("column_name"), F.col(c).alias("v")).distinct() for t, c in ((customer, "c_mktsegment"), (part, "p_type"), (part, "p_brand"))]
    return X.value_hits(few.unionByName(each), values[0].unionByName(values[1]).unionByName(values[2]))
