import random

from loomspark.llm.leaks import Automaton, distinct_items, find_leaks, remove_leaks, words_of

VOCAB = [f"w{i}" for i in range(400)]


def text(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


def automaton(items):
    return Automaton([(i, w, set(w)) for i, w in enumerate(items)])


def brute(item, doc, least=13, tolerance=8):
    """Does any stretch of the item stand in the document with at most one word in eight replaced, missing or added?"""
    whole = len(item) < least
    for a in range(1 if whole else len(item)):
        for b in range(len(item) if whole else a + least, len(item) + 1):
            part, edits = item[a:b], (b - a) // tolerance
            lost = len(part) if whole else len(part) - least
            if sum(x in doc for x in part) < len(part) - edits:
                continue
            for start in range(len(doc)):
                window = doc[start : start + len(part) + edits]
                # rows[j][e]: the fewest words of the stretch lost with e edits, when window[:j] is used
                rows = [[0 if e == j else 99 for e in range(edits + 1)] for j in range(len(window) + 1)]
                for x in part:
                    new = []
                    for j in range(len(window) + 1):
                        best = []
                        for e in range(edits + 1):
                            ways = [99]
                            if j and x == window[j - 1]:
                                ways.append(rows[j - 1][e])
                            if e:
                                ways.append(rows[j][e - 1] + 1)
                                if j:
                                    ways += [rows[j - 1][e - 1] + 1, new[j - 1][e - 1]]
                            best.append(min(ways))
                        new.append(best)
                    rows = new
                if min(min(r) for r in rows) <= lost:
                    return True
    return False


def test_against_brute_force():
    rng = random.Random(5)
    items = [text(rng, n) for n in (1, 3, 8, 9, 13, 16, 20, 30)]
    items += [text(rng, 5) + items[7][3:18] + text(rng, 9), items[7][:20] + text(rng, 6), items[7][6:19]]  # items inside items
    sam = automaton(items)
    cases = 0
    for _ in range(250):
        item = items[rng.randrange(len(items))]
        n = rng.randint(min(5, len(item)), len(item))
        at = rng.randint(0, len(item) - n)
        passage = item[at : at + n]
        for _ in range(rng.choice([0, 0, 1, 2, 2, 3])):
            p = rng.randrange(len(passage) + 1)
            passage = passage[:p] + rng.choice([[], [rng.choice(VOCAB)]]) + passage[p + rng.choice([0, 1, 1]) :]
        doc = text(rng, 4) + passage + text(rng, 4)
        got = set(sam.spans(doc))
        assert got == set(sam.spans(doc, whole=False)) == {k for k, w in enumerate(items) if brute(w, doc)}
        cases += len(got)
    assert cases > 100


def test_edits_one_word_apart():
    item = [f"w{i}" for i in range(16)]
    doc = item[:7] + ["x"] + item[8:9] + ["y"] + item[10:]
    assert automaton([item]).spans(doc) == {0: [(0, 16)]}
    assert not automaton([item]).spans(item[:5] + ["x"] + item[6:7] + ["y"] + item[8:9] + ["z"] + item[10:])


def test_item_that_goes_on_differently():
    b = [f"w{i}" for i in range(14)]
    a = ["p", *b[:13], "q", "r", "s"]
    assert set(automaton([a, b]).spans(a)) == {0, 1}


def test_words():
    assert words_of("<b>Sub-</b> exam-\nple, it­s [12] A_b x²") == ["sub", "example", "its", "a", "b", "x"]
    assert words_of(None) == [] and words_of("") == [] and words_of("?! ** <br/>") == []
    assert len(words_of("a " * 300_000)) == 300_000


def test_markup_has_no_length_bound():
    assert words_of(f'a <span class="{"x y " * 200}">b</span> c') == ["a", "b", "c"]
    assert words_of("if a<b and c> d then <br/> e") == ["if", "a", "b", "and", "c", "d", "then", "e"]


def table(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def test_stock_lines_and_rare_words(spark):
    stock = "solve the problem and give only the integer"
    items = [(i, f"{stock} x{i} y") for i in range(4)] + [(9, "alone, here"), (10, "Alone here!"), (11, stock), (12, None), (13, "?")]
    texts, ids = distinct_items(table(spark, items, "item_id bigint, text string"), "item_id", "text")
    got = {" ".join(r.words): sorted(r.rare) for r in texts.collect()}
    assert got == {**{f"x{i} y": [f"x{i}"] for i in range(4)}, "alone here": ["alone", "here"], stock: sorted(set(stock.split()))}
    assert sorted(r.item_id for r in ids.collect()) == [0, 1, 2, 3, 9, 10, 11]


def test_blocks_do_not_matter(spark):
    rng = random.Random(8)
    stock = text(rng, 15)
    lists = [stock + text(rng, rng.randint(3, 30)) for _ in range(6)] + [text(rng, rng.choice([2, 7, 12, 40])) for _ in range(30)]
    items = table(spark, [(i, " ".join(w)) for i, w in enumerate(lists)], "item_id bigint, text string")
    docs = [(0, " ".join(stock), 1), (1, "nothing to see", 1), (2, None, 1)]
    for i in range(60):
        w = list(rng.choice(lists))
        if len(w) > 16:
            w[rng.randrange(len(w))] = "changed"
        docs.append((10 + i, " ".join(text(rng, 5) + w + text(rng, 5) + rng.choice(lists)), 1))
    docs = table(spark, docs, "doc_id bigint, text string, item_id int")
    want = sorted(map(tuple, find_leaks(docs, items).collect()))
    assert want and not any(d < 10 for d, _ in want)
    assert sorted(map(tuple, find_leaks(docs, items, block_words=60).collect())) == want
    cut = sorted(map(tuple, remove_leaks(docs, items, max_coverage=0.6).collect()), key=lambda r: r[0])
    assert sorted(map(tuple, remove_leaks(docs, items, max_coverage=0.6, block_words=60).collect()), key=lambda r: r[0]) == cut
    assert cut[0][2] == 0 and any(r[1] is None for r in cut[3:]) and any(r[2] and r[1] for r in cut)


def test_frame(spark):
    rng = random.Random(1)
    a, b = " ".join(text(rng, 30)), " ".join(text(rng, 9))
    items = spark.createDataFrame([(1, a), (2, a.upper()), (3, b), (4, None), (5, ""), (6, "?")], "item_id bigint, text string")
    docs = spark.createDataFrame(
        [(1, f"intro words here. {a[: len(a) // 2 + 40]} end", 9), (1, f"intro words here. {a[: len(a) // 2 + 40]} end", 9), (2, f"x **{b}** y", 9), (3, "nothing at all", 9), (4, None, 9), (5, "", 9), (6, " ".join(b.split()[:6]), 9)],
        "doc_id bigint, text string, item_id bigint",
    )
    assert sorted(map(tuple, find_leaks(docs, items).collect())) == [(1, 1), (1, 2), (2, 3)]
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0
    assert sorted(map(tuple, find_leaks(docs, items, block_words=20).collect())) == [(1, 1), (1, 2), (2, 3)]
    clean = {r.doc_id: (r.text, r.removed_words) for r in remove_leaks(docs.dropDuplicates(["doc_id"]), items, max_coverage=0.9).collect()}
    assert clean[2] == ("x **** y", 9) and clean[3] == ("nothing at all", 0) and clean[4] == (None, 0)
