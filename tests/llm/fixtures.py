"""Small texts with what the operators must cope with."""

import random

SYLLABLES = "the of and tion ing er le la ou une der ein sch en es que los ción ñ é ß".split()


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))


def text(r, n):
    return " ".join(word(r) for _ in range(n))


def awkward_rows(seed=3):
    r = random.Random(seed)
    passage, other = text(r, 60), text(r, 45)
    rows = [(0, None), (1, ""), (2, "   \n\t"), (3, "one"), (4, "a " * 200), (5, "  é x " * 30), (None, text(r, 80))]
    for i in range(10, 40):
        body = text(r, r.randint(1, 150))
        if i % 3 == 0:
            body = f"{body} {passage} {text(r, r.randint(0, 40))}"
        if i % 5 == 0:
            body = f"{other}\n\n{body}\t{other}"
        rows.append((i, body))
    rows += [(i + 100, t) for i, t in rows[10:16]]  # exact copies
    rows += [(12, rows[12][1]), (None, rows[13][1]), (15, text(r, 50))]  # repeated rows and ids
    near = rows[20][1].split(" ")
    for i in range(200, 206):
        changed = list(near)
        changed[r.randrange(len(changed))] = word(r)
        rows.append((i, " ".join(changed)))
    rows.append((300, " ".join(passage.split()[:40] * 30)))
    r.shuffle(rows)
    return rows


def documents(spark, rows):
    """With columns whose names the operators use themselves."""
    full = [(d, t, "en", "s", len(t or ""), "x", 1, [1]) for d, t in rows]
    return spark.createDataFrame(
        full,
        "doc_id long, text string, lang string, source string, n_chars long, k1 string, start int, spans array<int>",
    )


def swapped_words(letters=1024):
    """Two different words, whose sums of letters times powers of an odd number are equal modulo 2**64."""
    bits = [bin(k).count("1") % 2 for k in range(letters)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
