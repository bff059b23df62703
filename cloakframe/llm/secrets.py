"""Secrets in texts: regular-expression candidates, then a random forest that removes false positives.

Everything on the main path is built-in SQL functions: candidates with their places and neighbours stay in their
document's row as an array, their features are expressions, and the fitted forest is one expression too.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.columns import chunks, let, piece, running

# Names of secrets, and first characters of known kinds of keys.
NAME = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret|encryption|signing|auth|client|account|master|shared)[ _-]?key|[a-z0-9][_-]key(?:[_-]?id)?|auth|credential)s?"
HEAD = r"(?:AKIA|ASIA|gh[opsur]_|github_pat_|xox[abprs]-|sk_live_|sk_test_|sk-|AIza)"

# A candidate: the value set for a name (in quotes, or up to white space), whatever its length and characters; a private
# key block (without an end, its lines of 16 and more characters); a key of a known kind, a web token with all its parts; or any run of at least 12 token characters with a digit in it.
_SIGN = r"(?:=>|:=|[=:]|[ \t]is[ \t])"
_SET = rf"(?<=(?i:{NAME})[\"']{{0,1}}[ \t]{{0,8}}{_SIGN}[ \t]{{0,8}}"
CANDIDATE = (
    rf"(?<=\"){_SET}\")(?:[^\"\\\r\n]++|\\.)++(?=\")|(?<='){_SET}')(?:[^'\\\r\n]++|\\.)++(?=')"
    rf"|(?<=[=:>][ \t]{{0,8}}[\"']{{0,1}}|[ \t]is[ \t]{{1,8}}[\"']{{0,1}}){_SET}[\"']{{0,1}})(?!(?i:bearer|basic)\s)(?![=>])[^\s\"',;](?:\S*[^\s\"',;])?"
    r"|-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----)[\s\S])*+-----END [A-Z0-9 ]{0,50}-----|(?:\s+[A-Za-z0-9+/=]{16,}+)*+)"
    r"|(?<![A-Za-z0-9_+/-])(?:eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)*|" + HEAD + r"[A-Za-z0-9_+/-]{8,}={0,2})"
    r"|(?<=(?i:bearer)\s)[A-Za-z0-9._~+/-]{8,}={0,2}"
    r"|(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{12,}={0,2}"
)

# Common pieces of identifiers, for dictionary coverage.
COMMON = (
    "the and for are was with this that from test example sample demo your user name path data file version node http www com org net html "
    "page index image img lib src main class item value order invoice product release build commit branch build module package report "
    "january february march april june july august september october november december monday tuesday wednesday thursday friday"
).split()

# Words beside a secret, and words beside look-alikes.
BEFORE = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)s?[\"']?\s*(=|:|=>|is)?\s*[\"']?$"
HARMLESS = r"(?i)(commit|sha-?\d*|md5|checksum|digest|etag|rev(ision)?|uuid|guid|isbn|card|phone|tel|order|invoice|id|v|version|build)\.?\s*(=|:|#|no\.?)?\s*[\"']?$"
# What stands for a secret without being one (empty values, placeholders, code that fetches it).
STAND_IN = (
    r"(?i)^(null|none|nil|true|false|yes|no|unset|empty|undefined|unknown|required|optional|hidden|redacted|invalid|expired|missing|str(ing)?|int|bytes|bool(ean)?|text|varchar|n/?a|todo|tbd)[.)!?]*$"
    r"|^[*.•_#xX-]+$|^(\$\{|\$\(|%\(|<|\{|\[)|^\$[A-Za-z_]+$|^%[A-Z_]+%$|^[A-Za-z_.]+[(\[]"
    r"|(?i)^(your|my|the|some|args|self|config|settings|options|params|env|environ|input|request|os|process)[._-]|(?i)^(pass(word|wd)?|token|secret|key|value)s?$"
)

FEATURES = {
    "length": "length(x.value)",
    "digits": "length(regexp_replace(x.value, '[^0-9]', '')) / length(x.value)",
    "upper": "length(regexp_replace(x.value, '[^A-Z]', '')) / length(x.value)",
    "vowels": "length(regexp_replace(lower(x.value), '[^aeiou]', '')) / length(x.value)",
    "marks": "length(regexp_replace(x.value, '[A-Za-z0-9]', '')) / length(x.value)",
    "distinct": "size(array_distinct(split(x.value, ''))) / length(x.value)",
    "transitions": r"(length(regexp_replace(x.value, '(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])', '##')) - length(x.value)) / (2.0 * length(x.value))",
    "hex": "cast(x.value rlike '^[0-9a-f]+$' as double)",
    "numeric": "cast(x.value rlike '^[0-9-]+$' as double)",
    "groups": "cast(x.value rlike '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$' as double)",
    "known_head": "cast(x.value rlike '^(" + HEAD + "|eyJ|-----BEGIN)' as double)",
    "dictionary": "1 - length(regexp_replace(lower(x.value), '" + "|".join(sorted(set(COMMON), key=lambda w: (-len(w), w))) + "', '')) / length(x.value)",
    "path": r"cast(x.value rlike '/.*/' or x.before rlike '([/\\\\.@]|://\\S*)$' or x.after rlike '^([/\\\\@]|\\.[a-z])' as double)",
    "named": "cast(x.before rlike '" + BEFORE.replace("\\", "\\\\").replace("'", "\\'") + "' as double)",
    "harmless": "cast(x.before rlike '" + HARMLESS.replace("\\", "\\\\").replace("'", "\\'") + "' as double)",
    "assigned": "cast(x.before rlike '" + rf"(?i){NAME}[\"']?[ \t]*{_SIGN}[ \t]*[\"']?$".replace("\\", "\\\\").replace("'", "\\'") + "' as double)",
    "equals": "cast(x.before rlike '=>?[\"\\']?$' as double)",
    "word": "cast(x.value rlike '^[A-Za-z]?[a-z]+([ .!?,-]+[A-Za-z]?[a-z]+)*[.!?)]*$' as double)",
    "stand_in": "cast(x.value rlike '" + STAND_IN.replace("\\", "\\\\").replace("'", "\\'") + "' as double)",
    "ends": r"cast(x.after rlike '^[,;]*[ \\t]*(\\r?\\n|$)' as double)",
    "quoted": "cast(x.before rlike '[\"\\']$' and x.after rlike '^[\"\\']' as double)",
}
# a value set as programs and settings do it, as prose after a colon is not
FEATURES["setting"] = "least({assigned}, 1 - {stand_in}, greatest({equals}, {quoted}, {ends}))".format(**FEATURES)


def candidates(text: Column) -> Column:
    """array<struct<start (code points from 0), value, before, after>> of a text's candidates; empty for null."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("hits"), F.split(text, CANDIDATE, -1).alias("gaps"))

    def placed(v: Column) -> Column:
        sizes = F.transform(v["gaps"], lambda g, i: F.length(g) + F.coalesce(F.length(F.get(v["hits"], i)), F.lit(0)))
        row = lambda h, i, ends: F.struct(
            (F.get(ends, i) - F.length(h)).alias("start"), h.alias("value"), F.substring(F.get(v["gaps"], i), -48, 48).alias("before"), F.substring(F.get(v["gaps"], i + 1), 1, 48).alias("after")
        )
        return let(let(sizes, running), lambda ends: F.transform(v["hits"], lambda h, i: row(h, i, ends)))

    return F.when(text.rlike(CANDIDATE), let(parts, placed)).otherwise(F.array().cast("array<struct<start:int,value:string,before:string,after:string>>"))


@dataclass
class Tree:
    """A node of a fitted tree: a split (feature <= cut) or a leaf (share of secrets)."""

    share: float
    feature: str = ""
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def sql(self) -> str:
        if self.low is None:
            return f"{self.share:.6f}D"
        return f"if(f.{self.feature} <= {self.cut:.9f}D, {self.low.sql()}, {self.high.sql()})"


def grow(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator, depth: int) -> Tree:
    share = float(y.mean()) if len(y) else 0.5
    if depth == 0 or len(y) < 6 or share in (0.0, 1.0):
        return Tree(share)
    best = (share * (1 - share) * len(y) - 1e-9, -1, 0.0)
    for j in rng.choice(x.shape[1], max(2, int(np.sqrt(x.shape[1]))), replace=False):
        values = np.unique(x[:, j])
        if len(values) < 2:
            continue
        for cut in np.unique(np.quantile((values[1:] + values[:-1]) / 2, np.linspace(0, 1, 9), method="nearest")):
            low = x[:, j] <= cut
            a, b = y[low], y[~low]
            impurity = a.mean() * (1 - a.mean()) * len(a) + b.mean() * (1 - b.mean()) * len(b)
            if impurity < best[0]:
                best = (impurity, int(j), float(cut))
    if best[1] < 0:
        return Tree(share)
    low = x[:, best[1]] <= best[2]
    return Tree(share, names[best[1]], best[2], grow(x[low], y[low], names, rng, depth - 1), grow(x[~low], y[~low], names, rng, depth - 1))


def labelled_findings(n: int = 1500, seed: int = 41) -> list[tuple[str, int]]:
    """Made-up labelled findings: one line of text each, its candidate a secret (1) or a look-alike (0)."""
    r = random.Random(seed)
    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    hexa, up, both = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    filler = ["of the", "and so", "was in", "der die", "que la", "le des", "then", "is at", "with a", "und nicht", "para", "une"]
    say = lambda: " ".join(r.choice(filler) for _ in range(r.randint(1, 4)))
    letters, named = "abcdefghijklmnopqrstuvwxyz", ["password", "db_password", "passwd", "pwd", "PASSWORD", "secret", "client_secret", "token", "auth_token", "api_key", "API_KEY", "passphrase", "credential"]
    gone = ["null", "None", "true", "False", "required", "optional", "string", "****", "********", "xxxx", "redacted", "unknown", "your-password", "your_token", "expired", "missing", "<password>", "[SECRET]", "password", "..."]
    word = lambda: "".join(r.choice(["ba", "do", "sun", "ter", "mi", "sword", "fish", "let", "gar", "den", "ro", "hun", "dra", "gon", "lo", "ve", "ing", "ma"]) for _ in range(r.randint(2, 4)))
    marks = "!@#$%^&*.?+-_~"

    def password() -> str:
        """A short one as people make them: a word, altered, with figures or punctuation, or random characters."""
        w = word()
        w = r.choice([w, w.capitalize(), w.replace("o", "0").replace("e", "3"), w.replace("a", "@")])
        return r.choice([w + pick("0123456789", r.randint(1, 4)), w + r.choice(marks) + pick("0123456789", r.randint(1, 4)), w + pick(marks, 2) + word(), pick(letters, 1) + pick(both + marks, r.randint(5, 14))])

    secrets = [
        lambda: r.choice(["", "key ", "aws_access_key_id = ", "AWS: "]) + r.choice(["AKIA", "ASIA"]) + pick(up, 16),
        lambda: r.choice(["password=", "password: ", "passwd = ", "pwd=", "db_password="]) + r.choice([pick(hexa, r.randint(14, 24)), pick(both, r.randint(12, 24)) + "7"]),
        lambda: r.choice(["token = ", "token=", "api_key = ", "secret: ", "auth_token: ", "access-key="]) + r.choice(['"%s"', "'%s'", "%s"]) % r.choice([pick(hexa, r.choice([32, 40, 64])), pick(both, 36) + "1"]),
        lambda: "Authorization: Bearer " + pick(both, r.randint(24, 60)) + "4",
        lambda: r.choice(["", "token "]) + "ghp_" + pick(both, 35) + "8",
        lambda: "private_key = " + pick(both + "+/", 63) + "9=",
        lambda: r.choice(["", "key ", "AWS: ", "see "]) + r.choice(["AKIA", "ASIA"]) + pick(letters.upper(), 16),
        lambda: r.choice(["", "use "]) + r.choice(["ghp_" + pick(both, 36), "xoxb-" + pick(both, 24), "sk_live_" + pick(both, 24), "AIza" + pick(both + "_-", 35), "sk-" + pick(both, 32)]),
        lambda: "Authorization: Bearer " + r.choice([pick(letters + letters.upper(), r.randint(16, 40)), "eyJ" + pick(both, 20) + ".eyJ" + pick(both, 30) + "." + pick(both, 30)]),
        lambda: r.choice(named) + r.choice(["=", " = ", ": "]) + password(),
        lambda: r.choice(named) + r.choice(["=", " = ", ": ", "': ", " => "]) + r.choice(['"%s"', "'%s'"]) % r.choice([password(), word(), pick(letters + letters.upper(), r.randint(12, 40)), word() + " " + password()]),
        lambda: r.choice(named) + "=" + r.choice([word(), pick(letters + letters.upper(), r.randint(6, 24))]),
        lambda: r.choice(named) + ": " + word() + "\n",
        lambda: r.choice(["my password is ", "the token is ", "passcode is "]) + password(),
        lambda: r.choice(named) + r.choice(["=", ": "]) + pick("0123456789", r.randint(4, 10)),
        lambda: r.choice(["token = ", "api_key = ", "secret: "]) + r.choice(['"%s"', "'%s'", "%s"]) % pick(letters + letters.upper(), r.randint(16, 40)),
        lambda: "-----BEGIN " + r.choice(["", "RSA ", "EC ", "OPENSSH "]) + "PRIVATE KEY-----\n" + "\n".join(pick(both + "+/", 64) for _ in range(r.randint(1, 4))) + "\n" + r.choice(["", "-----END PRIVATE KEY-----"]),
        lambda: r.choice(["", "session ", "jwt: "]) + "eyJ" + pick(both + "_-", 20) + ".eyJ" + pick(both + "_-", 30) + "." + pick(both + "_-", 30),
    ]
    plain = [
        lambda: r.choice(["password", "the secret", "Password", "token", "this token", "credentials", "pass"]) + r.choice([": ", " is "]) + word() + " " + say() + r.choice(["", "."]),
        lambda: r.choice(named) + r.choice(["=", ": ", " = "]) + r.choice(["%s", "%s\n", '"%s"']) % r.choice(gone),
        lambda: r.choice(["The secret: ", "password: ", "token: "]) + r.choice(filler) + " " + word() + ", " + say(),
        lambda: r.choice(named) + r.choice([" = ", "="]) + r.choice(["get_%s()", "os.environ['%s']", "${%s}", "<%s>", "{{ %s }}", "args.%s", "self.%s", "config.%s", "$%s", "getpass(%s)"]) % r.choice([word(), word().upper()]),
        lambda: r.choice(["sk-", "AKIA ", "eyJ "]) + "-".join(word() for _ in range(3)),
    ]
    harmless = [
        lambda: r.choice(["commit ", "sha ", "sha256: ", "md5=", "checksum ", "revision ", "etag: "]) + pick(hexa, r.choice([32, 40, 64])),
        lambda: r.choice(["", "uuid ", "id=", "request "]) + "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)),
        lambda: r.choice(["", "card ", "order ", "invoice no. ", "isbn "]) + pick("0123456789", r.randint(12, 16)),
        lambda: r.choice(["", "tel ", "phone "]) + "-".join(pick("0123456789", k) for k in (3, 3, 4, 4)),
        lambda: "https://www.example.com/" + r.choice(["images", "data", "node"]) + "/" + r.choice(["item", "page", "report"]) + "-" + pick("0123456789", 6) + "/" + pick(hexa, 12),
        lambda: "/usr/lib/" + r.choice(["module", "package", "release"]) + "-" + pick("0123456789", 3) + "/src/main/file" + pick("0123456789", 2),
        lambda: r.choice(["user", "sample", "build"]) + "_" + r.choice(["report", "version", "order", "test"]) + "_" + pick("0123456789", r.randint(4, 8)),
        lambda: r.choice(["", "see ", "file "]) + r.choice(["image", "index", "product"]) + "-" + pick("0123456789", 8) + "." + r.choice(["html", "png"]),
        lambda: pick("abcdefghijklmnopqrstuvwxyz", r.randint(11, 20)) + pick("0123456789", 1),
        lambda: pick("abcdefghijklmnopqrstuvwxyz", 7) + "_mail_" + pick("0123456789", 3) + "@mail.example.com",
        lambda: "password reset for order " + pick("0123456789", 12),
    ]
    harmless += plain * 2  # as many as there are secrets of the kinds that these look like
    out = []
    for i in range(n):
        good = i % 2 == 0
        out.append((f"{say()} {r.choice(secrets if good else harmless)()} {say()}", int(good)))
    return out


def _scored(found: str) -> Column:
    """found: an array column of candidates; the same with the struct f of features."""
    named = ", ".join(f"'{n}', cast({e} as double)" for n, e in FEATURES.items())
    return F.expr(f"transform({found}, x -> named_struct('start', x.start, 'value', x.value, 'f', named_struct({named})))")


_FITTED: dict[tuple, str] = {}


def forest_sql(spark: SparkSession, trees: int = 21, depth: int = 5, seed: int = 29) -> str:
    """The fitted forest as an expression over a struct f of features (fitted once per application and setting)."""
    key = (spark.sparkContext.applicationId, trees, depth, seed)
    if key not in _FITTED:
        lines = spark.createDataFrame(labelled_findings(), "text string, label int")
        rows = lines.withColumn("c", candidates(F.col("text"))).withColumn("c", _scored("c")).select("label", F.explode("c").alias("c")).select("label", "c.f.*").collect()
        x, y = np.array([[float(v) for v in r[1:]] for r in rows]), np.array([float(r.label) for r in rows])
        names, rng, forest = list(FEATURES), np.random.default_rng(seed), []
        for _ in range(trees):
            at = rng.integers(0, len(y), len(y))
            forest.append(grow(x[at], y[at], names, rng, depth).sql())
        _FITTED[key] = "(" + " + ".join(forest) + f") / {trees}"
    return _FITTED[key]


def with_secrets(docs: DataFrame, threshold: float = 0.5, column: str = "secrets") -> DataFrame:
    """docs and an array of its secrets: struct<start, value, score>, in text order.

    Null and empty texts have none, repeated rows are each answered, and the other columns (one called like the
    new one is replaced) stay as they are. start counts code points from 0.
    """
    forest = forest_sql(docs.sparkSession)
    found = docs.withColumn(column, candidates(F.col("text").cast("string"))).withColumn(column, _scored(f"`{column}`"))
    scored = F.expr(f"transform(`{column}`, x -> named_struct('start', x.start, 'value', x.value, 'score', transform(array(x.f), f -> {forest})[0]))")
    return found.withColumn(column, scored).withColumn(column, F.filter(F.col(column), lambda x: x["score"] >= threshold))


def redact(docs: DataFrame, mask: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """docs with every secret in text replaced by mask; all rows and columns stay."""
    found = with_secrets(docs, threshold, "__secrets")
    secrets = F.col("__secrets")

    def clean(v: Column) -> Column:
        end = lambda i: F.coalesce(F.get(secrets, i)["start"] + F.length(F.get(secrets, i)["value"]), F.lit(0))
        out = F.transform(secrets, lambda x, i: F.concat(piece(v["parts"], end(i - 1), x["start"] - end(i - 1)), F.lit(mask)))
        last = end(F.size(secrets) - 1)
        return F.concat(F.array_join(out, ""), piece(v["parts"], last, v["n"] - last))

    clean = let(F.struct(chunks(F.col("text")).alias("parts"), F.length("text").alias("n")), clean)
    return found.withColumn("text", F.when(F.size("__secrets") > 0, clean).otherwise(F.col("text"))).select(*docs.columns)
