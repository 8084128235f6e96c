"""Problems 7, 8 and 9."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrand.llm import leakage, packing, spam


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plan_packs_every_item_once(hist):
    plan = packing.plan_windows(hist, 64)
    assert all(sum(p) <= 64 for p in plan)
    packed = Counter()
    for p, n in plan.items():
        for s in p:
            packed[s] += n
    assert packed == Counter(hist)


def test_patterns_reach_all_lengths():
    hist = {s: 1 + (s % 7) for s in range(1, 2049)}
    found = packing.candidate_patterns(hist, 2048)
    assert {(a, 2048 - a) for a in range(1024, 2048)} <= set(found)
    often = [s for s, _ in Counter(hist).most_common(48)]
    thirds = {tuple(sorted((a, m, 2048 - a - m), reverse=True)) for a in hist for m in often if a + m < 2048}
    assert thirds <= set(found)


def test_plan_is_tight():
    rng = random.Random(1)
    hist = Counter(min(2048, max(1, int(rng.lognormvariate(5.7, 0.8)))) for _ in range(20000))
    plan = packing.plan_windows(hist)
    assert sum(s * n for s, n in hist.items()) / (2048 * sum(plan.values())) > 0.99


def test_fit_finds_exact_counts():
    patterns, hist = [(6, 4), (5, 5), (10,)], {6: 30, 4: 30, 5: 20, 10: 7}
    assert packing.fit_counts(patterns, hist) == pytest.approx([30, 10, 7], abs=0.1)


def test_windows(spark):
    sizes = [(i, n) for i, n in enumerate([10, 10, 10, 5, 5, 3, 25, 0, 20, 10])]
    lengths = spark.createDataFrame(sizes, "doc_id long, tokens long")
    rows = packing.pack(packing.window_items(lengths, 10), 10).collect()
    windows = {}
    for r in rows:
        windows.setdefault(r["window_no"], []).append((r["window_start"], r["size"]))
    for parts in windows.values():
        end = 0
        for start, size in sorted(parts):
            assert start == end
            end += size
        assert end <= 10
    whole = Counter()
    for r in rows:
        whole[r["doc_id"]] += r["size"]
    assert whole == {i: n for i, n in sizes if n}
    assert {r["doc_id"] for r in rows if r["piece_no"] > 0} == {6, 8}
    assert sorted(windows) == list(range(len(windows)))


def test_no_windows(spark):
    lengths = spark.createDataFrame([], "doc_id long, tokens long")
    assert packing.pack(packing.window_items(lengths)).count() == 0


@pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no vocabulary")
def test_tokens_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (None, "x"), (4, "<|endoftext|>"), (5, "word " * 50000), (6, " ")], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in packing.token_lengths(rows).collect()}
    assert set(got) == {1, 4, 5, 6} and got[1] == 2 and got[5] >= 50000 and got[4] > 1


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_segments_stand_on_the_pages_they_reach():
    segments = np.array([(5, 0, 3, 0, 0), (5, 3, 40, 3, 0), (5, 40, 41, 40, 0), (7, 0, 9, 50, 5)])
    width, pages = packing._pages(segments, {5: 41, 7: 9})
    rows = pages.to_pylist()
    assert width == {5: 14, 7: 9} and len(rows) <= 2 * len(segments)
    for size, n in ((5, 41), (7, 9)):
        for k in range(n):
            assert sum(r["size"] == size and r["page"] == k // width[size] and r["lo"] <= k < r["hi"] for r in rows) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=20))
def test_alignment_matches_brute_force(a, b):
    score, run = leakage.align(np.array(a), np.array(b))
    assert score == brute_align(a, b)
    assert run == max((n for n in range(len(a) + 1) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1) if a[i : i + n] == b[j : j + n]), default=0)


ITEM = "the old canal of Wigan was dug by hand in 1790 and then filled again by the council"


def leaks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as words", "1 as hits")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "'x' as gram")
    rows = leakage.alignments(d, i)
    return {tuple(r) for r in leakage.exact_leaks(rows).collect()}, {(r["doc_id"], r["item_id"]) for r in rows.collect()}


def test_leaks(spark):
    words = ITEM.split()
    docs = [
        (1, "so " + " ".join(words[:13]).upper() + " indeed"), (2, "so " + " ".join(words[:12]) + " indeed"), (3, "** " + "** - ".join(words[3:16])), (11, "<b>" + "</b> ".join(words[3:16])), (4, None), (5, ""), (6, "short one here!"), (7, "short one there"),
        (8, " ".join(w if i % 6 else "edited" for i, w in enumerate(words, 1))), (None, ITEM), (9, "filler " * 20000 + ITEM), (10, ITEM),
    ]
    items = [(1, ITEM), (2, "Short one, here"), (3, None), (4, " . "), (None, ITEM), (1, ITEM)]
    exact, aligned = leaks(spark, docs, items)
    assert exact == {(1, 1), (3, 1), (6, 2), (9, 1), (10, 1)}
    assert (8, 1) in aligned and (7, 2) not in exact


def test_edited_copy_of_a_hot_item(spark):
    words = [f"hot{i}" for i in range(24)]
    edited = " ".join("edited" if i % 7 == 6 else w for i, w in enumerate(words))
    docs = [(i, " ".join(words)) for i in range(250)] + [(999, edited), (1000, " ".join(words[:5]))]
    exact, aligned = leaks(spark, docs, [(1, " ".join(words))])
    assert exact == {(i, 1) for i in range(250)} and aligned == exact | {(999, 1)}


@pytest.mark.parametrize("bits", [1 << 16, 64])
def test_many_items_and_a_full_filter(spark, monkeypatch, bits):
    monkeypatch.setattr(leakage, "MOST_BITS", bits)
    items = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(10)]
    exact, _ = leaks(spark, [(i, f"x a{i} b{i} c{i} d{i} e{i} f{i} y") for i in range(10)], items)
    assert exact == {(i, i) for i in range(10)}
    assert leaks(spark, [(1, "a")], [])[0] == set() and leaks(spark, [], items)[0] == set()


PROSE = "The council of Wigan dug the canal because the marsh was wet. It was filled by the clerk in 1850, and the harbour has been closed since then. "
PAGES = {
    "keywords": "canal boat, cheap boat, boat buy, canal hire, best canal, canal price, boat sale, canal tour, boat hire, canal online",
    "links": "\n".join(f"[canal {i}](https://boats{i}.example/page)" for i in range(12)),
    "tags": " ".join(f"#boat{i}" for i in range(20)),
    "stuffed": "Get calm boats today. Our calm boats are calm boats! Why calm boats? Because calm boats. The calm boats of calm boats. Calm boats and calm boats.",
    "mixed": PROSE + "\n" + "\n".join(f"boat {i} https://boats{i}.example/page/of/offers" for i in range(12)),
}
FINE = {
    "prose": PROSE * 4,
    "sources": PROSE * 4 + "\nSources\nhttps://a.example/one\nhttps://b.example/two",
    "glossary": "\n".join(f"term{i}: The part of the canal that is near the lock and the mill." for i in range(8)),
    "answers": "\n".join(f"Question: Who dug the canal in {1800 + i}?\nAnswer: It was dug by the clerk of the council." for i in range(6)),
    "short": "n/a", "blank": " \n", "empty": "", "german": "Der Turm von Wigan wurde im Jahr 1850 durch den Rat erneuert. Die Leute nannten den Hafen einen stillen Ort. " * 3,
}


@pytest.mark.parametrize("name", PAGES)
def test_spam(name):
    assert spam.measure(PAGES[name]).spam


LINE = "Cheap canal boats for hire near Wigan and many more offers every day"
MORE_PAGES = {
    "line": "\n".join([LINE] * 100),
    "long phrase": " ".join(f"{a} the {b} of {c} big cheap canal boats near Wigan {d} and it was {e}." for a, b, c, d, e in zip(*(iter([f"w{i}" for i in range(60)]),) * 5)),
    "articles": "\n".join(f"{1042 + i} | large{i} copper{i} kettle{i} | {39 + i} EUR" for i in range(12)),
    "prices": "\n".join(f"{1042 + i} | 39 EUR | kettle" for i in range(12)),
    "parted": "boats for a canal, hire of a boat, tour to a dock, tea at a lock, ale at an inn, trip by a boat, sail on a sea, dock in a town",
}
MORE_FINE = {
    "openings": "\n".join(f"At the end of the summer {a} closed the {b} for {i} days." for i, (a, b) in enumerate(zip(["Ann", "Bob", "Cid", "Dan", "Eve"], ["mill", "quay", "lock", "barn", "dock"]))),
    "figures": PROSE * 3 + "\n" + "\n".join(f"{1900 + i} | {i}7.5 panels | late" for i in range(8)),
    "tabs": PROSE.replace(" ", "\t") * 2,
    "pasted": "\n".join(f"The lock {x} was {y} by the clerk of {z} in the year after." for x, y, z in zip("abcdefgh", ["dug", "cut", "shut", "sold", "won", "hid", "lost", "kept"], "stuvwxyz")) + "\n",
}


@pytest.mark.parametrize("name", MORE_PAGES)
def test_spam_by_lines_separators_and_long_phrases(name):
    page = spam.measure(MORE_PAGES[name])
    assert page.spam and (page.list_share > spam.LIST_SHARE) == (name in ("articles", "prices"))


@pytest.mark.parametrize("name", MORE_FINE)
def test_no_spam_by_them(name):
    assert not spam.measure(MORE_FINE[name] * (3 if name == "pasted" else 1)).spam


@pytest.mark.parametrize("name", FINE)
def test_no_spam(name):
    assert not spam.measure(FINE[name]).spam


FOREIGN = {
    "italian": "Il consiglio comunale ha deciso di ricostruire il vecchio ponte sul fiume perché le piene avevano danneggiato le arcate. Gli abitanti hanno protestato contro la chiusura del mercato e chiedono una nuova strada. La biblioteca resta aperta ogni giorno fino alle otto di sera.",
    "polish": "Rada miasta postanowiła odbudować stary most nad rzeką, ponieważ powodzie uszkodziły jego łuki. Mieszkańcy protestowali przeciwko zamknięciu targu i domagają się nowej drogi. Biblioteka jest otwarta codziennie do ósmej wieczorem, a muzeum zamyka się wcześniej.",
    "russian": "Городской совет решил восстановить старый мост через реку, потому что наводнения повредили его арки. Жители протестовали против закрытия рынка и требуют новую дорогу. Библиотека открыта каждый день до восьми вечера.",
    "dutch": "De gemeenteraad besloot de oude brug over de rivier te herstellen omdat de overstromingen de bogen hadden beschadigd. De bewoners protesteerden tegen de sluiting van de markt en eisen een nieuwe weg.",
    "portuguese": "A câmara municipal decidiu reconstruir a velha ponte sobre o rio porque as cheias tinham danificado os arcos. Os moradores protestaram contra o encerramento do mercado e pedem uma nova estrada.",
    "python": "def load(path):\n    with open(path) as handle:\n        rows = json.load(handle)\n    for row in rows:\n        yield row['key'], row.get('value', 0)\n\nclass Reader:\n    def __init__(self, name):\n        self.name = name\n        self.count = 0\n",
    "java": "public class Reader {\n    private int count = 0;\n    public int next() {\n        count += 1;\n        return count;\n    }\n}\n",
}
FOREIGN_LISTS = {
    "italian": "pane fresco, caffè espresso, pizza margherita, gelato artigianale, vino rosso, olio extravergine, formaggio stagionato, pasta fresca, dolci siciliani",
    "russian": "\n".join(f"купить лодку дёшево {i}" for i in range(12)),
}


@pytest.mark.parametrize("name", FOREIGN)
def test_prose_of_other_languages_and_code_are_no_lists(name):
    assert not spam.measure(f"{FOREIGN[name]} " * 2).spam and not spam.measure(FOREIGN[name]).spam


@pytest.mark.parametrize("name", FOREIGN_LISTS)
def test_lists_of_other_languages_are(name):
    assert spam.measure(FOREIGN_LISTS[name]).spam


def test_open_tags_and_brackets_take_no_longer():
    import time

    began = time.time()
    for text in ("<a href=x> word " * 30000, "<a " * 60000, "[" * 100000, "[word](" * 30000, "https://x.example/" * 5000):
        spam.measure(text)
    assert time.time() - began < 30


def test_shares_are_fitted_by_language(spark):
    rng = random.Random(4)
    words = [f"noun{i}" for i in range(200)]
    sentence = lambda few: " ".join(w for k in range(8) for w in ([rng.choice(few)] if k % 2 else []) + [rng.choice(words)]) + ". "
    pages = [(i, "".join(sentence(["the", "of", "and"]) for _ in range(8)), "EN ") for i in range(300)] + [(1000 + i, "".join(sentence(["der", "und"]) for _ in range(4)), "de") for i in range(20)]
    pages += [(2000 + i, ", ".join(rng.sample(words, 30)), "en") for i in range(40)] + [(3000, None, "en"), (3001, "x", None)]
    shares, errors = spam.fit_shares(spark.createDataFrame(pages, "doc_id long, text string, lang string"))
    assert shares["en"] == pytest.approx(0.8 / 3, abs=0.01) and errors["en"] < 0.02
    assert shares["de"] == spam.SENTENCE_SHARE["de"] and "de" not in errors
    assert spam.fit_shares(spark.createDataFrame([], "doc_id long, text string, lang string"))[0] == spam.SENTENCE_SHARE


def test_shares_are_fitted_on_all_pages(spark, monkeypatch):
    """Hardly over one in a hundred pages, of sentences with few function words, make the tail."""
    words = lambda i, few: " ".join(("the" if k < few else f"w{i}x{k}") for k in range(20)) + ". "
    pages = [(i, words(i, 6 if i % 91 == 7 else 10), "en") for i in range(9000)]
    read, stage = [], spam.stage
    monkeypatch.setattr(spam, "stage", lambda df, name: read.append(stage(df, name)) or read[-1])
    shares, errors = spam.fit_shares(spark.createDataFrame(pages, "doc_id long, text string, lang string"))
    assert shares["en"] == pytest.approx(0.8 * 0.3) and errors["en"] == 0
    assert read[0].count() == 9000


def test_scan_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, PAGES["links"] * 300), (4, PROSE * 1000), (None, PAGES["tags"]), (5, PAGES["tags"])]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as words", "'x' as spam")
    assert {r["doc_id"] for r in spam.scan(table).where("spam").collect()} == {3, 5}
    assert spam.scan(table.where("false")).count() == 0
