"""Small tables for the operators: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SYLLABLES = "the of and re tion en sh wh ble ou st".split()


def prose(r, words):
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) + r.choice(["", "", "", ",", "."]) for _ in range(words))


def odd_texts():
    r = random.Random(5)
    base = prose(r, 120)
    words = base.split(" ")
    near = words.copy()
    near[10] = "changed"
    far = [w if k % 4 else "other" for k, w in enumerate(words)]
    lines = "\n".join(prose(r, 6) for _ in range(6))
    return [
        None, "", " ", "\n\n\n\n", "one", "one two three", "One  TWO three", base, base, base.upper(), " ".join(near), " ".join(far), lines, "intro line\n" + lines + "\nlast line", "é ß 日本 😀 İ K",
        "a " * 3000, "Licensed under CC BY-NC 4.0.", "Released under the MIT License.\nand more", "x" * 5000, "tab\tand \x0b odd\u00a0space  double",
    ]


def documents(spark, texts=None, extra=True):
    texts = odd_texts() if texts is None else texts
    rows = [(k, t, "en" if k % 2 else "fr", f"src{k % 3}", len(t or ""), k) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    return frame if extra else frame.drop("score")


def empty(spark):
    return documents(spark, []).limit(0)
