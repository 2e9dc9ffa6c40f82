"""Line-first cleaning against a plain Python version."""

import random
import re

from pyspark.sql import functions as F

from tidewell.llm.quality_rules import BOILERPLATE, MARKS, SEPARATORS, Rules, clean_lines, keep_clean, quality_rules, repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, rules=Rules()):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = text.split("\n")
    full = [x for x in lines if WORD.search(x)]
    ink = lambda x: sum(map(len, WORD.findall(x)))
    def fails(x):
        marks, seps = len(re.findall(MARKS, x)), len(re.findall(SEPARATORS, x))
        return (marks >= rules.min_marks and marks * 100 >= ink(x) * rules.marks_percent) or (seps >= rules.min_separators and len(WORD.findall(x)) <= (seps + 1) * rules.words_per_separator) or (len(x) <= 200 and any(b in x.lower() for b in BOILERPLATE))
    bad = [x for x in lines if fails(x)]
    lost = sum(map(ink, bad))
    base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), ink(text), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered), base, not base and lost * 100 <= ink(text) * 30, len(full), len(bad), lost)


def cases():
    rng = random.Random(6)
    out = ["", None, " \n\t ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "a " * 50, "x\x1cy z \x0b\x0c end", "word " * 20, " ".join(str(i % 12) for i in range(200)), "All rights reserved.\n" + " ".join(f"w{i}" for i in range(30)), "home | about | contact | help\n" + "go!! " * 4 + " ".join(f"w{i}" for i in range(60)), "é ü 日本 " * 30]
    for _ in range(150):
        vocab = [f"w{i}" for i in range(rng.choice([3, 8, 300]))] + ["\n", "###", "|", "Stop.", "Terms of use", "\n\n", "\t"]
        out.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120))))
    block = " ".join(f"b{i}" for i in range(30))
    out += [block + " x " + block, block + " " + block + "\n" + block, " ".join(f"u{i}" for i in range(20000)) + " " + block + " q " + block]
    return out


def test_against_brute_force(spark):
    texts = cases()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(4)
    rows = {r.doc_id: tuple(r)[1:] for r in quality_rules(df).collect()}
    for i, t in enumerate(texts):
        assert rows[i] == brute(t), (i, (t or "")[:80])


def test_kept_documents(spark):
    prose = "\n".join(" ".join(f"line{j} word{i}" for i in range(12)) + "." for j in range(4))
    rows = [(1, prose, None, "s", len(prose)), (1, prose, None, "s", len(prose)), (None, prose + "\nhome | a | b | c", "en", None, 5), (3, None, None, None, None), (4, "short", None, None, 5), (5, "BUY!! NOW!! " * 40, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = keep_clean(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted([(1, prose, None, "s", len(prose))] * 2 + [(None, prose, "en", None, len(prose))], key=repr)
    clash = keep_clean(df.selectExpr("*", "'mine' kept", "-1 n_words", "'own' n_symbols"))
    assert {tuple(r)[-3:] for r in clash.collect()} == {("mine", -1, "own")}
    assert keep_clean(df.limit(0)).count() == 0 and clean_lines(df.limit(0)).count() == 0


def test_no_python_in_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = quality_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_clashing_window_hashes(spark):
    """Windows that share a hash with others between them in order are found all the same."""
    rng = random.Random(12)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(12)}" for _ in range(rng.randint(20, 60))]
        at, to = rng.randrange(10), rng.randrange(11, 20)
        words[to : to] = words[at : at + rng.choice([4, 8, 9])]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "id int, text string")
    weak = lambda w: F.pmod(F.xxhash64(w), F.lit(3).cast("long"))
    got = {r.id: r.n for r in df.select("id", repeated_words(F.split("text", " "), 8, weak).alias("n")).collect()}
    want = {}
    for i, text in rows:
        w = text.split()
        found = {}
        for k in range(len(w) - 7):
            found.setdefault(tuple(w[k : k + 8]), []).append(k)
        want[i] = len({p for at in found.values() if len(at) > 1 for k in at for p in range(k, k + 8)})
    assert got == want and any(want.values())
