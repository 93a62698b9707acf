"""Recall of the secret scan by form, in formats that its labelled findings do not have."""

import base64
import random
import uuid

from graphloom.llm.secrets import find_secrets

UPPER, DIGITS, HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
LOWER, WORDS = UPPER.lower(), "orange pepper kettle bridge copper velvet planet rocket tunnel silver".split()
ANY = UPPER + LOWER + DIGITS
EACH = 24
#: The least share of each form that has to be found; passwords made of words are the hardest.
LEAST = {"hex": 0.7, "password": 0.45, "passphrase": 0.45}
FORMATS = [
    'private static final String DB_SECRET = "{}";', "    api_token: {}\n    region: eu", "export APP_PASSWORD='{}'", '{{"auth": {{"secretKey": "{}"}}}}', "<credential>{}</credential>", "[db]\npasswd={}\nhost=x",
    'secret_access_key      = "{}"', 'set --token "{}" --force',
]


def forms(rng):
    run = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    url64 = lambda n: base64.urlsafe_b64encode(rng.randbytes(n)).decode().rstrip("=")
    return {
        "hex": lambda: run(rng.choice((20, 24, 32, 40, 48, 64)), HEX), "access key": lambda: "AKIA" + run(16, UPPER + "234567"), "forge token": lambda: rng.choice(("ghp_", "gho_", "ghs_")) + run(36, ANY),
        "live key": lambda: "sk_live_" + run(24, ANY), "bot token": lambda: "xoxb-" + run(11, DIGITS) + "-" + run(24, ANY), "maps key": lambda: "AIza" + run(35, ANY + "-_"), "project token": lambda: "glpat-" + run(20, ANY),
        "base64": lambda: base64.b64encode(rng.randbytes(rng.choice((24, 30, 33)))).decode(), "mixed": lambda: run(rng.choice((20, 24, 32, 40)), ANY), "letters": lambda: run(rng.choice((18, 20, 24, 32)), UPPER + LOWER),
        "password": lambda: rng.choice(WORDS).capitalize() + rng.choice("!@#%&*?") + run(rng.choice((3, 4, 5)), DIGITS) + run(2, LOWER), "passphrase": lambda: "-".join(rng.sample(WORDS, 4)),
        "web token": lambda: f"eyJ{url64(20)}.eyJ{url64(40)}.{url64(32)}", "url": lambda: run(12, ANY + "!_"),
    }


def test_recall_by_form(spark):
    rng = random.Random(99)
    rows, wanted = [], []
    for name, make in forms(rng).items():
        for k in range(EACH):
            secret = make()
            text = f"connect to mysql://svc:{secret}@db.internal:3306/app" if name == "url" else FORMATS[k % len(FORMATS)].format(secret)
            near = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))
            rows.append((len(rows), f"{near}\n{text}\n{near}"))
            wanted.append((name, secret))
    run = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    harmless = [
        lambda: "commit " + run(40, HEX), lambda: "sha256:" + run(64, HEX), lambda: str(uuid.UUID(bytes=rng.randbytes(16))), lambda: "https://site.org/a/" + "-".join(rng.sample(WORDS, 4)), lambda: "password: must be " + rng.choice(WORDS),
        lambda: "token = read_token()", lambda: "api_key: ${KEY_" + rng.choice(WORDS).upper() + "}", lambda: "order " + run(16, DIGITS), lambda: "/opt/" + "/".join(rng.sample(WORDS, 4)), lambda: "secret: " + rng.choice(WORDS),
    ]
    for k in range(120):
        rows.append((len(rows), f"{' '.join(rng.sample(WORDS, 4))} {harmless[k % len(harmless)]()} {rng.choice(WORDS)}"))
        wanted.append(("harmless", None))
    hits: dict[str, int] = {}
    for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect():
        name, secret = wanted[r.doc_id]
        hits[name] = hits.get(name, 0) + (bool(r.secrets) if secret is None else any(secret in x or x in secret for x in r.secrets))
    assert hits["harmless"] <= 6, hits
    for name in forms(rng):
        assert hits[name] >= LEAST.get(name, 0.9) * EACH, hits
