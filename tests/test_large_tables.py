"""What only shows on large tables, on tables that are large in one way alone."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from parchment.functions import text as T
from parchment.operators import outline as O
from parchment.operators.helpers import hanging
from parchment.plans import registry
from parchment.plans import views as V


def test_media_on_pages_far_into_a_document(spark, tmp_path):
    """Places on pages beyond 21,474 are more than whole numbers of 32 bits hold."""
    n = 21_480
    spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n - 2, "x").otherwise("a\nb\nc\nd").alias("text"), F.lit("s").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    placed = registry.QUERIES["place_media"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.kind, r.ref, r.ord, r.how) for r in placed) == [("s", "figure", str(p), p * 100_000 + 3, "caption") for p in (n - 2, n - 1)]


def test_titles_are_picked_once_from_the_start_of_a_text(spark, tmp_path):
    """The words of a title don't cost a pass over the whole text for every use of the title."""
    texts = ["One two three four", "a  b c", " 1,2 x-y z w", "nothing", "", "two\nlines of it here", "ends in "]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = lambda t: " ".join("".join(c for c in t if c == " " or c.isascii() and c.isalpha()).split(" ")[:3])
    number = lambda k: str(k // 3 + 1) + (f".{k % 3}" if k % 3 else "")
    out = V.outline(spark, str(tmp_path))
    assert sorted((r.ord, r.level, r.title, r.page) for r in out.collect()) == sorted((2 * k + c, 2 if k % 3 else 1, f"{number(k)} {kept(t)}", k + 1 + 40 * c) for k, t, _ in rows for c in (0, 1))
    plan = registry.QUERIES["outline_candidates"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^A-Za-z ]") == 1, plan


def test_orphans_and_gaps_of_numbers_that_repeat(spark):
    titles = ["1 A", "1 A", "1.1 B", "2.1 C", "2.1 C", "3.1.1 D", "Annex A", "14 E", "99999999999999999999 F"]
    out = O.hierarchy_valid(spark.createDataFrame([("d", t) for t in titles] + [("e", None), ("e", "Annex")], "doc_id string, title string")).collect()
    assert sorted(tuple(r) for r in out) == [("d", 9, 8, 3, 11, False), ("e", 2, 0, 0, None, False)]


def test_tokens_of_texts_are_counted_in_one_pass(spark):
    """Counts by patterns are those of a loop over the tokens; each is made once a text."""
    words = ["the", "The,", "(of)", "a", "A1", "naïve", "É", "résumé!", "abcé", "éabc", "İx", "aİb", "ab1", "1", "--", "…", "x>y", "A>B", "QQ<Z", "www.x=y", "a?b@c", "K2", "isoé", " ", "ab ", " the", "table.", "http://a|b", "a|b", "\x0b", "\x00\x01", "mm", "n", "ﬁx", "日本", "a日b"]
    r = random.Random(4)
    texts = ["", "   ", "x" * 19, " the of and to in that for are shall be this with "] + [r.choice(["", " ", "\n"]) + "".join(r.choice(words) + r.choice([" ", "  ", "\n", "\t", "\r\n"]) for _ in range(r.randrange(1, 40))) for _ in range(400)]

    def counts(t):
        raw = [w for w in re.split("[ \t\n\x0b\f\r]+", t.strip(" ")) if w]
        tokens = [w for w in (re.sub("^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$", "", w).lower() for w in raw) if w]
        alpha = [w for w in tokens if len(w) > 1 and all(unicodedata.category(c)[0] == "L" for c in w)]
        odd = sum(unicodedata.category(c)[0] == "C" or unicodedata.category(c) in ("Zl", "Zp") for c in t if c not in "\n\r\t")
        links = [w for w in raw if re.search(T.URLISH, w)]
        return (len(raw), len(tokens), len(alpha), sum(w in T.COMMON_WORDS for w in alpha), odd, sum(bool(re.search(T.GARBLE, w)) for w in raw), len(links), sum(bool(re.search(T.CIPHER, w)) and w not in links for w in raw))

    patterns = (T.TOKEN, T.WORDLIKE, T.LETTERS, T.KNOWN, T.ODD, T.GARBLED, T.LINKS, T.CIPHERED)
    out = spark.createDataFrame([(t,) for t in texts], "x string").select("x", *[F.regexp_count("x", F.lit(p)) for p in patterns]).collect()
    assert [tuple(o)[1:] for o in out] == [counts(o.x) for o in out]


def test_large_boxes_hang_together_without_their_pairs(spark):
    """Boxes that mostly overlap: links grow with the boxes and the cells they lie in, not with the pairs."""
    r = random.Random(2)
    boxes = [(page, k, x := r.gauss(0, 200), y := r.gauss(0, 200), x + r.choice([1, 150, 400]), y + r.choice([5, 150, 400])) for page in (0, 1) for k in range(page * 5000, page * 5000 + 800)]
    boxes += [(0, 9000 + k, 5000.0 + 40 * k, 0.0, 5020.0 + 40 * k, 10.0) for k in range(5)]
    b = spark.createDataFrame(boxes, "page_idx int, id long, x0 double, y0 double, x1 double, y1 double")
    padded = b.selectExpr("page_idx", "id", "x0 - 5 as x0", "y0 - 5 as y0", "x1 + 5 as x1", "y1 + 5 as y1")
    near = lambda a, c: a[0] == c[0] and a[2] - 5 <= c[4] and c[2] <= a[4] + 5 and a[3] - 5 <= c[5] and c[3] <= a[5] + 5
    pairs = {(c[1], a[1]) for i, a in enumerate(boxes) for c in boxes[:i] if near(a, c) or near(c, a)}

    def joined(links):
        up = {x[1]: x[1] for x in boxes}

        def find(k):
            while up[k] != k:
                k = up[k]
            return k

        for a, c in links:
            a, c = find(a), find(c)
            up[max(a, c)] = min(a, c)
        return {k: find(k) for k in up}

    links = [(x.a, x.b) for x in hanging(padded, b, ["page_idx"]).collect()]
    assert {(min(x), max(x)) for x in links} <= pairs and joined(links) == joined(pairs)
    assert len(links) < len(pairs) / 3, (len(links), len(pairs))
