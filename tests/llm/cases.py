"""Documents with every awkward case, and plain-Python counterparts of the contracts."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row long, size long, h string, n long, words string, component string, copies int"
EXTRA = ("x", 1, 2, "y", 3, "z", "c", 9)


def rows():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage = text(120), text(40)
    texts = [None, "", "   ", "one", "ONE", "one two", "a\tb\n c", "a b c", "a  b c", "Ünïcode – ÀÉ straße Σας", "<|endoftext|> x", "12½ it's", text(9000), "spam " * 3000]
    texts += [base, base.upper(), base + " end", "start " + base, base.replace(" ", "\n")] * 2
    texts += [text(30) + " " + passage + " " + text(30) for _ in range(6)]
    for k in range(40):
        words = base.split()
        for _ in range(r.choice([0, 1, 1, 2, 5, 9])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [text(r.randint(3, 200)) for _ in range(40)]
    out = [(i, t, r.choice(["en", "fr", None]), r.choice(["a", "a", "a", "b", "c", None]), len(t or ""), *EXTRA) for i, t in enumerate(texts)]
    return out + [(None, "null id", None, "a", 7, *EXTRA), (None, None, None, None, None, *EXTRA)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")
