"""Documents of every awkward kind, with further columns whose names operators use inside."""

import random

TOKENS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(TOKENS) + r.choice(["", "", ".", ","]) + str(r.randrange(40)) for _ in range(n))


def rows() -> list[tuple]:
    base, other, shared = prose(1, 300), prose(2, 280), prose(3, 70)
    changed = base.split(" ")
    changed[150] = "changed"
    texts = [base, base, " ".join(changed), base.upper(), other, f"{prose(4, 60)} {shared} {prose(5, 50)}", f"{shared} {prose(6, 90)}", f"{prose(7, 200)} {shared}", None, "", " ", "one", "one two three", "!!! ... \n\n", "naïve café déjà vu " * 3, "ab " * 900, "日本語のテキスト" * 40, prose(8, 12_000), prose(9, 5), "x" * 5000, "\n\n  tabs\tand  runs \n x", "<|endoftext|> a<|startoftext|>b"]
    out = [(i, t, "en" if i % 3 else "fr", f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    out.append((0, base, "en", "src0", len(base)))  # a repeated row
    out.append((None, prose(10, 40), None, None, None))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["score", "start", "block", "anchor", "key", "label", "n", "row", "spans", "text_hash", "bucket", "salt", "rank", "left", "right", "part"]


def documents(spark, some=None):
    data = rows() if some is None else some
    df = spark.createDataFrame(data, SCHEMA)
    for name in CLASHES:
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df
