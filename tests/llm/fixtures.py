"""Small tables with the cases that every operator defines a result for."""
import random

WORDS = "the and of to in is that it was for on are with as be at this from or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows, extra=True):
    """Rows of (doc_id, text) as a documents table with columns whose names operators use inside."""
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        cols += ", n long, key string, h1 long, bucket int, ids string"
    return spark.createDataFrame([(i, t, "en" if i is None or i % 3 else None, "s", len(t or "")) + ((1, "k", 2, 3, "x") if extra else ()) for i, t in rows], cols)


def odd_rows():
    rng = random.Random(2)
    long = text(rng, 3000)
    same = text(rng, 80)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "two words"), (6, same), (7, same), (8, same.upper()), (8, same.upper()), (9, long), (10, "日本 é 😀 " * 20), (11, "a" * 3000), (None, text(rng, 60)), (12, "x y z " * 40), (13, same + " more")]
