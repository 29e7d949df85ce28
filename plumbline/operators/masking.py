"""Sensitive data: categories by name and by value, spread over lineage, masks in three styles, secrets by line."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.durable import settle

# Categories of column names; the first that matches wins. A weak pattern counts after the strong ones.
NAMES = (
    ("phone", r"(^|_)(mobile|phone|tel|telephone|msisdn)(_?(no|num|number))?(_|$)"),
    ("id_card", r"(^|_)(id_?card|idcard|identity|id_?no|cert_?no|citizen_?id)(_|$)"),
    ("bank_card", r"(^|_)(bank_?(card|acct|account)|card_?no|acct_?no|account_?no|iban)(_|$)"),
    ("passport", r"passport"),
    ("email", r"(^|_)e?mail(_?addr(ess)?)?(_|$)"),
    ("person_name", r"(^|_)((user|real|full|cust(omer)?|contact|legal)_?name)(_|$)"),
    ("address", r"(^|_)(?<!ip_)(addr|address|home_?addr(ess)?|ship(ping)?_?addr(ess)?)(_|$)"),
    ("salary", r"(^|_)(salary|income|wage)(_|$)"),
    ("birthday", r"(^|_)(birth(day|date)?|date_?of_?birth|dob)(_|$)"),
    ("license_plate", r"(^|_)(license_?plate|plate_?no|car_?no)(_|$)"),
    ("ip_address", r"(^|_)(ip|ip_?addr(ess)?|client_?ip)(_|$)"),
)
WEAK_NAMES = (("person_name", r"(^|_)name(_|$)"),)
# Words of a column's comment.
COMMENTS = (
    ("phone", ("手机", "电话", "联系方式")),
    ("id_card", ("身份证", "证件号", "证件号码")),
    ("bank_card", ("银行卡", "卡号", "银行账号")),
    ("passport", ("护照",)),
    ("email", ("邮箱", "电子邮件")),
    ("person_name", ("姓名", "联系人")),
    ("address", ("地址", "住址")),
    ("salary", ("工资", "薪资", "薪酬", "收入")),
    ("birthday", ("出生", "生日")),
    ("license_plate", ("车牌",)),
    ("ip_address", ("IP地址", "ip地址")),
)
SEVERITY = {"phone": "high", "id_card": "high", "bank_card": "high", "passport": "high", "ip_address": "low"}
# Shapes of whole values, and the share of a column that must have one.
SHAPES = (
    ("phone", r"^1[3-9]\d{9}$"),
    ("id_card", r"^(\d{15}|\d{17}[\dXx])$"),
    ("email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    ("bank_card", r"^\d{16,19}$"),
)
SHARE = 0.6
# Shapes inside of texts.
INSIDE = (
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("phone", r"\b\d{3}[-.]?\d{3,4}[-.]?\d{4}\b"),
    ("id_number", r"\b\d{15,18}[xX]?\b"),
    ("credit_card", r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b"),
)
# Functions that hide a value for good.
MASKING = r"(?i)\b(md5|sha|sha1|sha2|sha256|hash|crc32|murmur_hash|mask|mask_hash|mask_first_n|mask_last_n|mask_show_first_n|mask_show_last_n|aes_encrypt|encrypt|regexp_replace|overlay|substr|substring)\s*\("
# Secrets in a line of text. A pattern with a group is filtered for placeholders.
SECRETS = (
    ("aws_access_key", "high", r"\bAKIA[0-9A-Z]{16}\b", 0),
    ("aws_secret_key", "high", r"(?i)(?:aws[_-]?)?secret[_-]?(?:access[_-]?)?key\s*[:=]\s*['\"][A-Za-z0-9/+=]{40}['\"]", 0),
    ("github_token", "high", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,255}\b", 0),
    ("gitlab_pat", "high", r"\bglpat-[A-Za-z0-9_\-]{20,}\b", 0),
    ("slack_token", "high", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", 0),
    ("aliyun_ak", "high", r"\bLTAI[A-Za-z0-9]{12,24}\b", 0),
    ("private_key", "high", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY", 0),
    ("jwt", "medium", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}\b", 0),
    ("password_assign", "medium", r"(?i)\b[\w.-]*(?:password|passwd|pwd)\s*[:=]\s*['\"]([^'\"\s]{6,})['\"]", 1),
    ("apikey_assign", "medium", r"(?i)\b(?:api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token)\s*[:=]\s*['\"]([A-Za-z0-9_\-.]{16,})['\"]", 1),
    ("url_credentials", "medium", r"\b[a-z][a-z0-9+.-]{1,20}://[^/\s:@'\"]{1,64}:([^@/\s'\"]{4,64})@", 1),
)
#: What a line must have for any of them to match, in one cheap pass.
HINT = r"(?i)akia|secret|gh[pousr]_|glpat-|xox[baprs]-|ltai|private key|eyj|passw|pwd|://|[:=]\s*['\"]"
ENTROPY_PATTERN = r"[:=]\s*['\"]([A-Za-z0-9/+_\-]{20,})['\"]"
ENTROPY_LEAST = 4.0
# Random-looking assignments, marks of placeholders, and the mark of lines to leave out.
PLACEHOLDERS = ("${", "{{", "<", "$(", "%s", "xxx", "***", "...", "your", "example", "changeme", "change_me", "dummy", "placeholder", "sample", "redacted", "insert", "fixme", "todo", "secret_here")
PRAGMA = "secretscan:ignore"


def category_of_name(name: str) -> str | None:
    return next((c for c, p in (*NAMES, *WEAK_NAMES) if re.search(p, name.lower())), None)


def pii_by_name(df_catalog: DataFrame, extra: Sequence[tuple[str, str, str, str]] = ()) -> DataFrame:
    """``table_name, column_name, category, severity`` of the catalog's columns whose names tell a category.

    ``extra`` has rules of one's own (category, severity, name pattern, words of the comment
    joined by '|'), which come first. With a ``comment`` column, words of the comment count
    where the name tells nothing, and a weak pattern (a bare 'name') only after both.
    """
    low = F.lower("column_name")
    strong = [(F.lit(c), F.lit(sev), low.rlike(p)) for c, sev, p, _ in extra if p] + [(F.lit(c), None, low.rlike(p)) for c, p in NAMES]
    weak = [(F.lit(c), None, low.rlike(p)) for c, p in WEAK_NAMES]
    worded = []
    if "comment" in df_catalog.columns:
        words = [(c, sev, w) for c, sev, _, w in extra if w] + [(c, None, "|".join(w)) for c, w in COMMENTS]
        worded = [(F.lit(c), F.lit(sev) if sev else None, F.coalesce(F.col("comment"), F.lit("")).rlike(w)) for c, sev, w in words]
    known = lambda c: F.when(c.isin(*[k for k, v in SEVERITY.items() if v == "high"]), "high").when(c == "ip_address", "low").otherwise("medium")
    hit = F.coalesce(*[F.when(on, F.struct(c.alias("category"), (known(c) if sev is None else sev).alias("severity"), F.lit(kind).alias("by"))) for kind, rules in (("name", strong), ("comment", worded), ("weak name", weak)) for c, sev, on in rules])
    return df_catalog.select("table_name", "column_name", hit.alias("h")).filter("h is not null").select("table_name", "column_name", "h.category", "h.severity")


def pii_by_value(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, category, share``: the first shape that at least 60 % of a column's values have; one scan of all values."""
    cells = [F.avg(F.col(c).cast("string").rlike(p).cast("double")).alias(f"{c}|{k}") for c in columns for k, p in SHAPES]
    rows = []
    for c in columns:
        hit = F.coalesce(*[F.when(F.col(f"`{c}|{k}`") >= SHARE, F.struct(F.lit(k).alias("category"), F.col(f"`{c}|{k}`").alias("share"))) for k, _ in SHAPES])
        rows.append(F.struct(F.lit(c).alias("column_name"), hit.alias("hit")))
    return df.agg(*cells).select(F.explode(F.array(*rows)).alias("r")).filter("r.hit is not null").select("r.column_name", "r.hit.category", "r.hit.share")


def pii_inside(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, category, rows_hit, occurrences`` of shapes anywhere in the texts, in one scan."""
    cells = [x for c in columns for k, p in INSIDE for x in (F.count_if(F.col(c).rlike(p)).alias(f"{c}|{k}|r"), F.coalesce(F.sum(F.regexp_count(F.col(c), F.lit(p))), F.lit(0)).alias(f"{c}|{k}|n"))]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("category"), F.col(f"`{c}|{k}|r`").alias("rows_hit"), F.col(f"`{c}|{k}|n`").cast("long").alias("occurrences")) for c in columns for k, _ in INSIDE])
    return df.agg(*cells).select(F.explode(rows).alias("r")).select("r.*").filter("rows_hit > 0")


def mask_preserving(x: Column, category: str) -> Column:
    """A mask that keeps the shape: phone 3+4, id 6+4, e-mail first letter and domain, bank last 4, name first, address 6, ip without its last two numbers, else the edges."""
    n = F.length(x)
    stars = F.repeat(F.lit("*"), n)
    if category == "phone":
        out = F.when(n >= 8, F.concat(F.substring(x, 1, 3), F.lit("****"), F.right(x, F.lit(4)))).otherwise(stars)
    elif category == "id_card":
        out = F.when(n >= 12, F.concat(F.substring(x, 1, 6), F.repeat(F.lit("*"), F.lit(8)), F.right(x, F.lit(4)))).otherwise(stars)
    elif category == "email":
        out = F.when(F.locate("@", x) > 0, F.concat(F.substring(x, 1, 1), F.lit("***@"), F.substring(x, F.locate("@", x) + 1, n))).otherwise(F.concat(F.substring(x, 1, 1), F.lit("***")))
        out = F.when(F.locate("@", x) == 1, F.concat(F.lit("***@"), F.substring(x, F.lit(2), n))).otherwise(out)
    elif category == "bank_card":
        out = F.when(n >= 8, F.concat(F.lit("**** **** **** "), F.right(x, F.lit(4)))).otherwise(stars)
    elif category == "person_name":
        out = F.concat(F.substring(x, 1, 1), F.repeat(F.lit("*"), F.greatest(F.lit(1), n - 1)))
    elif category == "address":
        out = F.concat(F.substring(x, F.lit(1), F.when(n > 6, 6).otherwise(1)), F.lit("****"))
    elif category == "salary":
        out = F.lit("***")
    elif category == "ip_address":
        out = F.regexp_replace(x, r"(\d+)\.(\d+)$", "*.*")
    else:
        out = F.when(n <= 2, stars).otherwise(F.concat(F.substring(x, 1, 1), F.repeat(F.lit("*"), n - 2), F.right(x, F.lit(1))))
    return F.when(x.isNull() | (x == ""), x).otherwise(out)


def mask_report(x: Column, category: str) -> Column:
    """The style of comparison reports; null is '***'."""
    n, out = F.length(x), F.lit("***")
    if category == "email":
        local, domain = F.substring_index(x, "@", 1), F.substring(x, F.locate("@", x) + 1, n)
        dots = F.locate(".", domain) > 0
        tail = F.when(dots, F.concat(F.lit("."), F.substring_index(domain, ".", -1))).otherwise("")
        out = F.when(F.locate("@", x) > 0, F.concat(F.when(local == "", "*").otherwise(F.substring(local, 1, 1)), F.lit("***@"), F.when(domain == "", "*").otherwise(F.substring(domain, 1, 1)), F.lit("***"), tail)).otherwise(out)
    elif category == "phone":
        out = F.when(n >= 7, F.concat(F.substring(x, 1, 3), F.lit("****"), F.right(x, F.lit(4)))).otherwise(out)
    elif category == "id_number":
        out = F.when(n >= 7, F.concat(F.substring(x, 1, 3), F.repeat(F.lit("*"), n - 7), F.right(x, F.lit(4)))).otherwise(out)
    elif category == "credit_card":
        digits = F.regexp_replace(x, "[^0-9]", "")
        out = F.when(F.length(digits) >= 4, F.concat(F.lit("**** **** **** "), F.right(digits, F.lit(4)))).otherwise(out)
    return F.when(x.isNull(), "***").otherwise(out)


def mask_result(x: Column, kind: str) -> Column:
    """The style of query results; null and empty stay."""
    n = F.length(x)
    plain = F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(x, 1, 1), F.repeat(F.lit("*"), n - 2), F.right(x, F.lit(1))))
    if kind == "email":
        local = F.substring_index(x, "@", 1)
        out = F.when(F.locate("@", x) > 0, F.concat(F.substring(local, 1, 1), F.lit("***@"), F.substring(x, F.locate("@", x) + 1, n))).otherwise(plain)
    elif kind == "phone":
        out = F.when(n >= 7, F.concat(F.substring(x, 1, 3), F.lit("****"), F.right(x, F.lit(2)))).otherwise(plain)
    elif kind == "id":
        out = F.when(n >= 10, F.concat(F.substring(x, 1, 4), F.repeat(F.lit("*"), n - 7), F.right(x, F.lit(3)))).otherwise(plain)
    elif kind == "bank":
        out = F.when(n >= 8, F.concat(F.substring(x, 1, 4), F.repeat(F.lit("*"), n - 8), F.right(x, F.lit(4)))).otherwise(plain)
    else:
        out = plain
    return F.when(x.isNull() | (x == ""), x).otherwise(out)


def masked(df: DataFrame, categories: Mapping[str, str], style: str = "preserving") -> DataFrame:
    """``df`` with its sensitive columns masked in one of the styles preserving, report, result."""
    how = {"preserving": mask_preserving, "report": mask_report, "result": mask_result}[style]
    return df.withColumns({c: how(F.col(c).cast("string"), k) for c, k in categories.items()})


def pii_spread(column_edges: DataFrame, sensitive: DataFrame, depth: int = 5) -> DataFrame:
    """``src_column, category, reached, unmasked_edges``: where a sensitive column flows, and edges that copy it unmasked.

    ``column_edges`` has ``src, dst, expression``; each hop is one join, edges that mask end the flow.
    """
    hidden = F.coalesce(F.col("expression").rlike(MASKING), F.lit(False))
    e = settle(column_edges.select("src", "dst", hidden.alias("masked")))
    seen = front = sensitive.select(F.col("column_name").alias("root"), "category", F.col("column_name").alias("node"))
    hops = None
    for _ in range(depth):
        step = front.join(e, F.col("node") == F.col("src")).select("root", "category", F.col("dst").alias("node"), "masked")
        hops = step if hops is None else hops.unionByName(step)
        front = settle(step.filter(~F.col("masked")).select("root", "category", "node").distinct().join(seen, ["root", "node"], "left_anti").select("root", "category", "node"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return hops.groupBy(F.col("root").alias("src_column"), "category").agg(F.count_distinct("node").alias("reached"), F.count_if(~F.col("masked")).alias("unmasked_edges"))


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: a lambda's variable, for an expression within lambdas is worked out anew for each of their items."""
    return F.element_at(F.transform(F.array(x), use), 1)


def entropy(x: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""

    def bits(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda y: y == c)) / n)
        return F.when(n > 0, -F.aggregate(F.transform(parts, lambda p: p * F.log2(p)), F.lit(0.0), lambda a, b: a + b)).otherwise(F.lit(0.0))

    return once(F.filter(F.split(x, ""), lambda c: c != ""), bits)


def _placeholder(x: Column) -> Column:
    out = F.lit(False)
    for m in PLACEHOLDERS:
        out = out | F.contains(F.lower(x), F.lit(m))
    return out


def preview(x: Column) -> Column:
    return F.when(F.length(x) <= 8, F.concat(F.substring(x, 1, 2), F.lit("…"))).otherwise(F.concat(F.substring(x, 1, 4), F.lit("…"), F.right(x, F.lit(2))))


def secret_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, line, rule, severity, masked``: rules on every line of the texts; the value itself is never returned.

    A high hit makes generic assignment rules of the line redundant; placeholders do not count
    for rules with a value; entropy decides only where no rule has matched.
    """
    lines = docs.select(key, F.posexplode(F.split(text, r"\r\n|[\r\n]")).alias("line", "x")).filter(~F.contains("x", F.lit(PRAGMA)))
    lines = lines.filter(F.col("x").rlike(HINT))
    cells = []
    for rule, severity, p, group in SECRETS:
        value = F.regexp_extract("x", p, group)
        ok = F.col("x").rlike(p) & (~_placeholder(value) if group else F.lit(True))
        cells.append(F.when(ok, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), preview(value).alias("masked"))))
    found = F.array_compact(F.array(*cells))
    is_high = lambda x: F.exists(x, lambda f: f["severity"] == "high")
    kept = once(found, lambda x: once(is_high(x), lambda high: F.filter(x, lambda f: ~(high & f["rule"].isin("apikey_assign", "password_assign")))))
    v = F.regexp_extract("x", ENTROPY_PATTERN, 1)
    classes = v.rlike("[a-z]").cast("int") + v.rlike("[A-Z]").cast("int") + v.rlike("[0-9]").cast("int")
    random = F.col("x").rlike(ENTROPY_PATTERN) & ~_placeholder(v) & (classes >= 2) & (entropy(v) >= ENTROPY_LEAST)
    rest = F.when(random, F.array(F.struct(F.lit("high_entropy").alias("rule"), F.lit("low").alias("severity"), preview(v).alias("masked"))))
    all_found = once(kept, lambda x: F.when(F.size(x) > 0, x).otherwise(rest))
    return lines.select(key, (F.col("line") + 1).alias("line"), F.explode(all_found).alias("f")).select(key, "line", "f.rule", "f.severity", "f.masked")
