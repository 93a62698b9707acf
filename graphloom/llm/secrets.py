"""Secret scans with a random forest that removes false positives; DataFrame operations only.

Candidates are wide: whatever stands after a key word and ":" or "=" (any length and characters), passwords in URLs, private-key
blocks, dotted tokens, and runs of 16 or more token characters with a digit or mixed case. What is a secret is left to a forest
over their features (length, character transitions, dictionary coverage, path, neighbouring words), trained from labelled
findings. The trained trees become one SQL expression, so scoring stays in the plan of the scan; texts without candidates cost
one regular expression.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import text_of

RUN = r"[A-Za-z0-9+/_\-]"
SEPARATOR = r"[\"'`]?[ \t]{0,3}(?::=|=>|[:=])[ \t]{0,3}"
#: Words whose value is a candidate, and what may follow them in a name.
KEY = r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_\-]?key|(?:access|private|secret|auth|encryption|signing|master|account)[_\- ]?key|credentials?|auth|bearer)[A-Za-z0-9_\-]{0,20}"
URL_USER = r"[A-Za-z][A-Za-z0-9+.\-]{0,20}://[^\x00-\x20/:@]{0,64}:"
SCHEME = r"(?i:bearer|basic)[ ]{1,3}"
PREFIX = rf"(?:{URL_USER}|{KEY}{SEPARATOR}[\"'`]?|{SCHEME})"
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
    rf"|{URL_USER}[^\x00-\x20/@]++(?=@)"
    rf"|{KEY}{SEPARATOR}(?:\"[^\"\n]++(?=\")|'[^'\n]++(?=')|`[^`\n]++(?=`)|{SCHEME}{RUN}++[.=]*+|[^\x00-\x20\"'`]++)"
    rf"|{SCHEME}[A-Za-z0-9._~+/\-]{{16,}}+={{0,2}}"
    r"|(?<![A-Za-z0-9])eyJ[A-Za-z0-9_\-]++(?:\.[A-Za-z0-9_\-]++){1,4}"
    rf"|(?<!{RUN})(?={RUN}{{16}})(?!{RUN}{{0,64}}?{KEY}{SEPARATOR})(?=[A-Za-z+/_\-]*+[0-9]|[A-Za-z+/_\-]*?[a-z][A-Z]){RUN}++={{0,2}}"
)
MASK = "[SECRET]"
#: Characters before and after a candidate that are looked at.
BEFORE, AFTER = 48, 16
TREES, DEPTH, SEED = 40, 8, 7
#: Share of trees from which a candidate is a secret.
VOTES = 0.5
#: Rows of the labelled findings that training makes; a table of one's own may be given instead, up to MAX_LABELLED rows of it.
LABELLED, MAX_LABELLED = 8000, 200_000
#: Words of the vocabulary in which three letters have to occur to count as a part of words.
COMMON = 6
#: What stands for the space before a word in vocabulary files: the byte-level sign and the pieces' one.
WORD_STARTS = ("\u0120", "\u2581")
SECRET_WORDS = "key|token|secret|passw|pwd|passphrase|passcode|credential|bearer|apikey|signature"
PLAIN_WORDS = "commit|sha|md5|digest|checksum|hash|uuid|guid|revision|build|version|isbn|phone|card|order|invoice|ticket|etag|blob|base64"
PLACEHOLDER = r"(?i)^(?:[$%{<\[(*]|your|my[_\-]|example|sample|test|dummy|change|replace|insert|enter|placeholder|required|optional|undefined|none|null|nil|true|false|string|redacted|x{3,}|os\.|process\.|env)|\*{3}|x{6}|\(|_here$|\.\.\."
FEATURES = (
    "length", "digits", "uppers", "symbols", "spaces", "hex_only", "digits_only", "letters_only", "transitions", "distinct", "coverage",
    "slashes", "in_path", "dashes", "dots", "known_prefix", "assigned", "quoted", "secret_word", "plain_word", "placeholder", "url_user", "block",
)


@cache
def word_parts(vocabulary: str | None = None) -> tuple[int, ...]:
    """The dictionary: which three letters are parts of the vocabulary's words, as bits of 275 longs.

    vocabulary: a tokenizers file whose word-initial tokens are the words; read by the driver.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    with open(vocabulary, encoding="utf-8") as file:
        tokens = json.load(file)["model"]["vocab"]
    counts: dict[str, int] = {}
    for token in tokens:
        word = token[1:].lower()
        if token[:1] in WORD_STARTS and re.fullmatch("[a-z]{3,}", word):
            for part in {word[i : i + 3] for i in range(len(word) - 2)}:
                counts[part] = counts.get(part, 0) + 1
    bits = [0] * 275
    for part, n in counts.items():
        if n >= COMMON:
            k = part_number(part)
            bits[k // 64] |= 1 << k % 64
    return tuple(x - (1 << 64) if x >> 63 else x for x in bits)


def part_number(part: str) -> int:
    x, y, z = (ord(c) - 97 for c in part)
    return (x * 26 + y) * 26 + z


def coverage(candidate: Column, vocabulary: str | None = None) -> Column:
    """The share of a candidate's three-letter parts that are parts of words; 1 where it has none."""
    letter = lambda x, i: F.ascii(F.substring(x, i, 1)) - 97
    table = F.array(*(F.lit(x).cast("long") for x in word_parts(vocabulary)))
    number = lambda x: ((letter(x, 1) * 26 + letter(x, 2)) * 26 + letter(x, 3)).cast("int")
    known = lambda x: F.getbit(F.get(table, F.floor(number(x) / 64).cast("int")), number(x) % 64) == 1
    share = lambda parts: F.when(F.size(parts) > 0, F.size(F.filter(parts, known)) / F.size(parts)).otherwise(1.0)

    def of(letters: Column) -> Column:  # letters as an array, for the place of a character in a long text has to be sought
        at = F.sequence(F.lit(0), F.greatest(F.size(letters) - 3, F.lit(0)))
        parts = F.transform(at, lambda i: F.concat(F.get(letters, i), F.get(letters, i + 1), F.get(letters, i + 2)))
        return _let(F.filter(parts, lambda x: x.rlike("^[a-z]{3}$")), share)

    return _let(F.split(F.lower(candidate), ""), of)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feature_columns(candidate: Column, before: Column, after: Column, vocabulary: str | None = None) -> list[Column]:
    """The features of one candidate, as doubles in the order of FEATURES."""
    n = F.greatest(F.length(candidate), F.lit(1)).cast("double")
    gone = lambda pattern: n - F.length(F.regexp_replace(candidate, pattern, ""))
    near = F.lower(F.right(before, F.lit(BEFORE)))
    changes = F.length(F.regexp_replace(candidate, r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", "x"))
    flag = lambda c: c.cast("int").cast("double")
    return [
        F.length(candidate).cast("double"),
        gone("[0-9]") / n,
        gone("[A-Z]") / n,
        gone("[^A-Za-z0-9]") / n,
        gone(" "),
        flag(candidate.rlike("^[0-9a-fA-F]+$")),
        flag(candidate.rlike(r"^[0-9\-]+$")),
        flag(candidate.rlike("^[A-Za-z]+$")),
        changes / n,
        F.size(F.array_distinct(F.split(candidate, ""))) / n,
        coverage(candidate, vocabulary),
        gone("/"),
        flag(near.rlike(r"(https?:|www\.)[^\x00-\x20]*$|[/.@\\]$") | after.rlike(r"^[./@][A-Za-z0-9_]")),
        gone("-"),
        gone(r"\."),
        flag(candidate.rlike("^(AKIA|ASIA|gh[pousr]_|sk_|pk_|rk_|xox|AIza|eyJ|glpat)")),
        flag(near.rlike(r"[:=][ \t]*[\"'`]?$")),
        flag(near.rlike("[\"'`]$")),
        flag(near.rlike(f"({SECRET_WORDS})[a-z0-9_\\-]*[\"'`]?[^a-z0-9_]{{0,6}}$")),
        flag(near.rlike(f"({PLAIN_WORDS})[a-z_\\-0-9]*[^a-z0-9_]{{0,6}}$")),
        flag(candidate.rlike(PLACEHOLDER)),
        flag(near.rlike("://[^\\x00-\\x20/:@]*:$")),
        flag(candidate.rlike("^-----BEGIN")),
    ]


def labelled_findings(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """Findings with known labels: before, candidate, after, label (1: secret). The same rows each time.

    The label says how a row was made: secrets are random strings of the forms that keys and passwords have, the others are
    words, names, numbers, digests, paths and placeholders. Both stand behind names of settings; neither the names nor the
    words are those that the features look for, though some are among them.
    """
    df = spark.range(rows).coalesce(1)
    draw = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    pick = lambda salt, items: F.element_at(F.array(*map(F.lit, items)), (draw(salt, len(items)) + 1).cast("int"))
    digest = lambda salt: F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(salt)), 256)
    b64 = lambda salt: F.base64(F.unhex(digest(salt)))
    cut = lambda text, salt, sizes: F.left(text, pick(salt, sizes).cast("int"))
    words = "the of time report house summer river data model sample value order north garden music letter paper window winter story people market street light water number simple green table village system account normal general public second history".split()
    word = lambda salt: pick(salt, words)
    upper = F.translate(cut(b64("u"), "u", [16]), "+/=abcdefghijklmnopqrstuvwxyz", "XYZABCDEFGHIJKLMNOPQRSTUVWXYZ")
    mixed = F.translate(cut(b64("m"), "m", [20, 28, 36]), "+/=", "aB3")
    letters = F.translate(cut(b64("l"), "l", [16, 20, 24]), "+/=0123456789", "xYzabCdefGhij")
    mark = lambda salt: pick(salt, list("!@#%^&*?+~"))
    leet = F.translate(F.initcap(word("e")), "aeos", "4305")
    password = F.concat(pick("pa", ["", "x", "Q"]), leet, pick("pb", ["", "!", "@", "#", "."]), cut(F.translate(b64("pc"), "+/=", "kM7"), "pd", [2, 3, 4, 6]), mark("pe"), draw("pf", 9999).cast("string"))
    phrase = F.replace(F.concat_ws("-", word("a"), word("b"), word("c"), F.when(draw("pn", 2) == 0, word("d"))), F.lit("-"), pick("ph", ["-", "-", " ", "_"]))
    text = pick("t", ["an on the ", "report of ", "and see ", "y de la ", "von der ", "", "(", "value was "])
    name = F.concat_ws("-", word("a"), word("b"), word("c"), draw("n", 9999).cast("string"), word("d"))
    key = F.concat(
        pick("k", ["token", "password", "api_key", "secret", "passwd", "auth_token", "DB_PASSWORD", "access key", "credentials", "client_secret", "private_key", "login pass", "accessKey", "\"apiKey\"", "pwd", "x-api-key", "admin credential"]),
        pick("ks", ["=", ": ", " = ", "=\"", ": \"", " = '", ":", ": '"]),
    )
    about = F.concat(
        pick("p", ["commit", "sha256", "md5", "digest", "checksum", "uuid", "revision", "etag", "hash", "trace", "session nr", "parent", "tree", "fingerprint", "object"]),
        pick("ps", [" ", ":", "=", ": ", "=\""]),
    )
    uuid = F.regexp_replace(F.left(digest("i"), F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    hexes = lambda salt, sizes: F.substring(digest(salt), F.lit(1), pick(salt + "n", sizes).cast("int"))
    number = F.regexp_replace(F.concat(F.conv(F.substring(digest("q"), 1, 14), 16, 10), F.lit("0123456789")), "^(.{16}).*$", "$1")
    block = F.concat(F.lit("-----BEGIN "), pick("bk", ["RSA ", "", "EC ", "OPENSSH "]), F.lit("PRIVATE KEY-----\n"), b64("b1"), F.lit("\n"), b64("b2"), F.lit("\n-----END PRIVATE KEY-----"))
    dotted = F.concat(F.lit("eyJhbGciOi"), F.translate(b64("j1"), "+/=", "_-a"), F.lit("."), F.translate(b64("j2"), "+/=", "_-a"), F.lit("."), F.translate(b64("j3"), "+/=", "_-a"))
    url = F.concat(pick("us", ["postgres", "mysql", "https", "redis", "amqp"]), F.lit("://"), pick("uu", ["admin", "app", "root", "", "svc"]), F.lit(":"))
    blank = pick("y", ["${SECRET}", "<your-token>", "your_api_key_here", "xxxxxxxx", "changeme", "none", "null", "true", "********", "os.environ['KEY']", "process.env.TOKEN", "REPLACE_ME", "string", "required", "{{ password }}", "$PASSWORD", "example-key", "[SECRET]", "get_token()", "test", "undefined", "..."])
    camel = F.concat(word("x"), F.initcap(word("y")), F.initcap(word("z")), F.initcap(word("w")))
    kinds = [  # (before, candidate, label)
        (key, hexes("h", [12, 16, 18, 20, 32, 40, 64]), 1),
        (text, F.concat(pick("ak", ["AKIA", "ASIA"]), upper), 1),
        (key, F.concat(F.lit("AKIA"), upper), 1),
        (text, F.concat(pick("g", ["ghp_", "sk_live_", "AIza", "xoxb-", "glpat-"]), mixed), 1),
        (key, cut(b64("s"), "sn", [24, 40, 44]), 1),
        (key, mixed, 1),
        (key, letters, 1),
        (key, password, 1),
        (key, password, 1),
        (key, phrase, 1),
        (url, F.coalesce(F.when(draw("uq", 2) == 0, password), mixed), 1),
        (text, block, 1),
        (pick("jt", ["", "Authorization: Bearer ", "jwt: ", "token=", "cookie "]), dotted, 1),
        (pick("bt", ["Authorization: Bearer ", "bearer ", "Authorization: Basic "]), F.translate(cut(b64("be"), "bn", [24, 32, 44]), "=", "A"), 1),
        (about, hexes("c", [16, 32, 40, 64]), 0),
        (about, uuid, 0),
        (text, uuid, 0),
        (F.concat(text, F.lit("https://www.example.org/")), F.concat_ws("/", word("e"), name), 0),
        (F.concat(text, F.lit("/home/")), F.concat_ws("/", word("f"), word("g"), F.concat(word("h"), draw("v", 99).cast("string"))), 0),
        (text, name, 0),
        (text, F.concat(word("x"), word("y"), word("z"), word("w"), draw("o", 99999).cast("string")), 0),
        (text, camel, 0),
        (pick("l", ["card ", "order ", "call +", "phone: ", "isbn ", ""]), number, 0),
        (text, hexes("r", [16, 20, 24, 32, 40]), 0),
        (F.concat(text, F.lit("data:image/png;base64,")), b64("d"), 0),
        (key, blank, 0),
        (key, blank, 0),
        (key, word("wa"), 0),
        (key, F.concat(word("wb"), pick("wp", ["", ",", ".", ";", ")"])), 0),
        (key, F.concat_ws("_", word("va"), word("vb")), 0),
        (url, blank, 0),
    ]
    made = F.element_at(F.array(*[F.struct(b.alias("before"), c.alias("candidate"), F.lit(label).alias("label")) for b, c, label in kinds]), (F.pmod("id", F.lit(len(kinds))) + 1).cast("int"))
    return df.select(made.alias("x"), pick("z", ["", "\"", " the ", "'", ", on", ".", "\n", "@host/db"]).alias("after")).select("x.before", "x.candidate", "after", "x.label")


def train_forest(labelled: DataFrame, vocabulary: str | None = None) -> str:
    """A random forest on labelled findings (before, candidate, after, label), as SQL: the share of trees for a secret.

    Features are fields of a struct called f. At most MAX_LABELLED rows are used: training is the one step with such a bound.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    columns = feature_columns(F.col("candidate"), F.col("before"), F.col("after"), vocabulary)
    rows = labelled.limit(MAX_LABELLED).select(*[c.alias(n) for c, n in zip(columns, FEATURES)], F.col("label").cast("double").alias("label")).coalesce(1)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(vectors)
    trees = [tree_as_sql(t.toDebugString) for t in model.trees]
    return f"({' + '.join(trees)}) / {len(trees)}D"


def tree_as_sql(described: str) -> str:
    """The nested IFs of a printed decision tree."""
    lines = iter([x.strip() for x in described.splitlines() if re.match(r"\s*(If|Else|Predict)", x)])

    def node() -> str:
        line = next(lines)
        if line.startswith("Predict"):
            return f"{float(line.split(':')[1])}D"
        feature, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        left = node()
        next(lines)  # Else
        return f"IF(f.{FEATURES[int(feature)]} <= {limit}D, {left}, {node()})"

    return node()


def scanned(rows: DataFrame, forest: str, vocabulary: str | None = None) -> DataFrame:
    """rows: other columns and text. With found (array of prefix, candidate, secret) and pieces (what stands around those).

    A match is a prefix, such as a key word, and the candidate behind it; the prefix counts as what stands before.
    """
    out = rows.withColumn("matches", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(CANDIDATE), F.lit(0)))
    n = F.size("matches")
    out = out.withColumn("pieces", F.when(n > 0, F.split("text", CANDIDATE, -1)).otherwise(F.array(F.coalesce("text", F.lit("")))))
    around = F.arrays_zip(F.col("matches").alias("m"), F.slice("pieces", 1, n).alias("b"), F.slice("pieces", 2, n).alias("a"))
    prefix = lambda y: F.regexp_extract(y["m"], f"^{PREFIX}", 0)
    split = F.transform(
        F.transform(around, lambda y: F.struct(y["m"].alias("m"), prefix(y).alias("prefix"), y["b"].alias("b"), y["a"].alias("a"))),
        lambda y: F.struct(
            y["prefix"].alias("prefix"),
            F.substr(y["m"], F.length(y["prefix"]) + 1).alias("candidate"),
            F.concat(F.right(y["b"], F.lit(BEFORE)), y["prefix"]).alias("b"),
            F.left(y["a"], F.lit(AFTER)).alias("a"),
        ),
    )
    out = out.withColumn("split", F.when(n > 0, split))
    features = F.transform("split", lambda y: F.struct(*[c.alias(k) for c, k in zip(feature_columns(y["candidate"], y["b"], y["a"], vocabulary), FEATURES)]))
    out = out.withColumn("features", features).withColumn("secret", F.expr(f"transform(features, f -> {forest} >= {VOTES}D)"))
    found = F.transform(F.arrays_zip("split", "secret"), lambda x: F.struct(x["split"]["prefix"].alias("prefix"), x["split"]["candidate"].alias("candidate"), (x["secret"] & (x["split"]["candidate"] != "")).alias("secret")))
    none = F.array().cast("array<struct<prefix:string,candidate:string,secret:boolean>>")
    return out.withColumn("found", F.when(n > 0, found).otherwise(none)).drop("matches", "split", "features", "secret")


def _redacted() -> Column:
    """The text with MASK for each secret, from the pieces and what was found."""
    shown = F.transform("found", lambda x: F.concat(x["prefix"], F.when(x["secret"], F.lit(MASK)).otherwise(x["candidate"])))
    pairs = F.arrays_zip(F.slice("pieces", 1, F.size("found")).alias("a"), shown.alias("b"))
    return F.concat(F.array_join(F.transform(pairs, lambda x: F.concat(x["a"], x["b"])), ""), F.element_at("pieces", -1))


def find_secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row for each input row: doc_id, n_candidates, n_secrets, secrets (distinct, in order), redacted_sha256.

    labelled: findings to train on (before, candidate, after, label); vocabulary: the tokenizers file whose words are the
    dictionary. A null or empty text has no candidates. Repeated rows are scanned each; a null id stays null; an empty table
    gives an empty result; other columns are not read. Very long texts and candidates are scanned whole, in time and memory of
    their length.
    """
    forest = train_forest(labelled if labelled is not None else labelled_findings(docs.sparkSession), vocabulary)
    hits = F.filter("found", lambda x: x["secret"])
    return scanned(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), forest, vocabulary).select(
        "doc_id",
        F.size("found").cast("long").alias("n_candidates"),
        F.size(hits).cast("long").alias("n_secrets"),
        F.array_distinct(F.transform(hits, lambda x: x["candidate"])).alias("secrets"),
        F.sha2(_redacted().cast("binary"), 256).alias("redacted_sha256"),
    )


def redact_secrets(docs: DataFrame, labelled: DataFrame | None = None, text_col: str = "text", size_col: str = "n_chars", vocabulary: str | None = None) -> DataFrame:
    """docs with MASK in place of each secret; all rows and columns stay, and size_col, if there, follows the new text.

    Null and empty texts stay as they are; repeated rows and null ids each have their row; texts of any length are scanned whole;
    an empty table stays empty.
    """
    forest = train_forest(labelled if labelled is not None else labelled_findings(docs.sparkSession), vocabulary)
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    some = F.exists("found", lambda x: x["secret"])
    out = scanned(base, forest, vocabulary).select("row", F.when(some, _redacted()).alias("new"))
    own = {c: F.col(f"row.`{c}`") for c in docs.columns}
    changed = {text_col: F.coalesce("new", own[text_col])}
    if size_col in own:
        changed[size_col] = F.when(F.col("new").isNotNull(), F.length("new").cast(docs.schema[size_col].dataType)).otherwise(own[size_col])
    return out.select(*[changed.get(c, own[c]).alias(c) for c in docs.columns])
