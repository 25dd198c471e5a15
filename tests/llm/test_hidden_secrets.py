import random
import re
import string
import uuid

from pyspark.sql import functions as F

from tessera.llm import secrets

BASE62 = string.ascii_letters + string.digits
FORMS = ["aws_secret_access_key={}", "client_credentials_key={}", "connection_string_account_key={}", "/home/user/config/{}/settings/page", "service-account-name-{}"]


def test_secrets_behind_names_and_in_paths(spark):
    rng, alphabet = random.Random(2), string.ascii_letters + string.digits
    rows = []
    for k in range(60 * len(FORMS)):
        secret = "".join(rng.choice(alphabet) for _ in range((20, 32, 40)[k % 3]))
        before, after = FORMS[k % len(FORMS)].split("{}")
        rows.append((k, f"some words {before}{secret}{after} and more", 11 + len(before), 11 + len(before) + len(secret)))
    two = "first_account_key=v7GkPz81mQwRr3TnB0xLa9YuCe/second_account_key=Zt4hQx92LmPw7RkVb5NcJ1sDg8"
    rows.append((-1, two, two.index("v7"), len(two)))
    plain = [r.token for r in secrets.training_sample(spark, 3000).where("not random").collect()]
    rows += [(10_000 + k, t, None, None) for k, t in enumerate(plain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s int, e int")
    got = secrets.scan(docs, secrets.train(secrets.training_sample(spark))).withColumn("clean", secrets.redacted(F.col("text"), F.col("secrets"))).collect()
    there = [r for r in got if 0 <= r.doc_id < 10_000]
    covered = [any(x.s <= r.s and r.e <= x.e for x in r.secrets) for r in there]
    assert sum(covered) >= 0.95 * len(there), sum(covered) / len(there)
    both = next(r for r in got if r.doc_id == -1)
    assert len(both.secrets) == 2 and both.clean.count("[secret]") == 2 and "v7Gk" not in both.clean and "sDg8" not in both.clean
    assert sum(bool(r.secrets) for r in got if r.s is None) <= 0.01 * len(plain)


def walked(run, w, least=0.8):
    """The parts of a run that look random, window by window."""
    n, size = len(secrets.ALPHABET) + 1, secrets.WINDOW

    def ratio(token):
        codes = [0, *(secrets.ALPHABET.index(c) + 1 for c in token)]
        return sum(w[a * n + b] for a, b in zip(codes, codes[1:])) / len(token)

    told = lambda t: re.search("[0-9]", t) and re.search("[A-Za-z]", t)
    if not told(run):
        return []
    if ratio(run) >= least:
        return [(0, len(run))]
    runs = []
    for i in range(len(run) - size + 1):
        if "=" in run[i : i + size] or ratio(run[i : i + size]) < least:
            continue
        if runs and not any(c in secrets.JOINTS for c in run[runs[-1][1] : i]):
            runs[-1][1] = i + size
        else:
            runs.append([i, i + size])
    out = []
    for s, e in runs:
        while s and run[s - 1] not in secrets.JOINTS:
            s -= 1
        while e < len(run) and run[e] not in secrets.JOINTS:
            e += 1
        out.append((s, e))
    return [(s, e) for s, e in out if told(run[s:e])]


def test_parts_of_runs_are_those_of_a_plain_walk(spark):
    rng, w = random.Random(11), secrets.train(secrets.training_sample(spark))
    plain = [r.token for r in secrets.training_sample(spark, 400).where("not random").collect()]
    key = lambda: "".join(rng.choice(BASE62 + "+") for _ in range(rng.randint(8, 44)))
    runs = ["".join(rng.choice([rng.choice(plain), key(), "-" * rng.randint(1, 9)]) + rng.choice("=/_-x") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    runs = [t for t in runs if len(t) >= 20]
    docs = spark.createDataFrame([(k, f"so {t} on") for k, t in enumerate(runs)], "k long, text string")
    got = {r.k: [(x.s - 3, x.e - 3) for x in r.secrets if x.kind == 3] for r in secrets.scan(docs, w).where("forall(secrets, x -> x.kind = 3)").collect()}
    assert len(got) > 300 and sum(map(bool, got.values())) > 100
    assert {k: sorted(set(walked(runs[k], w))) for k in got} == got


def pick(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def ordinary(rng):
    """By kind, tokens that are not secrets though they have digits and letters."""
    d = lambda n: pick(rng, string.digits, n)
    word = lambda: rng.choice("linux kernel render engine core Qt boost report backup photo invoice meeting cluster worker stage prod region widget gdal proj".split())
    return {
        "ruler": ["-----------------------------a1----", *(c * rng.randint(20, 60) + rng.choice(["a1", "B2c", "page3"]) + c * rng.randint(0, 30) for c in "-=_" for _ in range(30)), "-=" * 14 + "x9"],
        "date": ["2024-05-12T10-33-21_backup", *(f"20{d(2)}-0{rng.randint(1, 9)}-1{d(1)}{j}{d(2)}-{d(2)}-{d(2)}{z}" for j in "T_" for z in ("Z", "-report", "Z_log") for _ in range(15))],
        "stamp": [f"{word()}{word()}_20{d(2)}0{rng.randint(1, 9)}1{d(1)}T{d(6)}Z" for _ in range(80)],
        "path": ["gnu/libQt5WebEngineCore", "usr/lib/x86_64-linux-gnu/libboost_filesystem-mt-x64", "lib/python3/dist-packages/yaml", *(f"usr/lib/aarch64-linux-gnu/lib{word()}{rng.randint(2, 9)}{word().title()}{word().title()}" for _ in range(80))],
        "version": [f"{word()}-{word()}-{word()}-{d(1)}-{d(2)}-{d(1)}-amd64" for _ in range(80)],
        "order": [f"ORDER-{d(8)}-{d(6)}-{d(4)}" for _ in range(80)],
        "uuid": [str(uuid.UUID(int=rng.getrandbits(128), version=4)) for _ in range(80)],
    }


def planted(rng):
    """By kind, random tokens that no pattern names."""
    forms = {"base62": (BASE62, "{}"), "base64": (BASE62 + "+/", "{}"), "url-safe": (BASE62 + "-_", "{}"), "upper": (string.ascii_uppercase + string.digits, "{}"), "lower": (string.ascii_lowercase + string.digits, "{}"), "prefix": (BASE62, "ghp_{}"), "path": (BASE62, "/home/user/config/{}/page")}
    return {k: [f.format(pick(rng, a, rng.choice([24, 32, 40]))) for _ in range(80)] for k, (a, f) in forms.items()}


def test_precision_and_recall_by_kind(spark):
    """Rulers, stamps, paths, versions, numbers and lower-case UUIDs stay; random tokens are found."""
    rng = random.Random(12)
    cases = [(k, t, False) for k, ts in ordinary(rng).items() for t in ts if len(t) >= 20] + [(k, t, True) for k, ts in planted(rng).items() for t in ts]
    docs = spark.createDataFrame([(k, f"see {t} here", secret) for k, t, secret in cases], "kind string, text string, secret boolean")
    w = secrets.train(secrets.training_sample(spark))
    told = secrets.scan(docs, w).groupBy("secret", "kind").agg(F.count_if(F.size("secrets") > 0).alias("found"), F.count("*").alias("n")).collect()
    print({(r.secret, r.kind): round(r.found / r.n, 3) for r in told})
    assert all(r.found >= 0.95 * r.n if r.secret else r.found <= 0.03 * r.n for r in told), told


def test_models_of_poor_samples(spark):
    empty = spark.createDataFrame([], "token string, random boolean")
    assert set(secrets.train(empty)) == {0.0}
    some = spark.createDataFrame([(None, True), ("abc", None), ("", False), ("\u00e9!", True)], "token string, random boolean")
    assert set(secrets.train(some)) == {0.0}
