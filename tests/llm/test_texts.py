"""Tokenizer, leakage and stuffing."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stackweave.llm import leakage, stuffing, tokenizer

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokenizer.VOCABULARY), reason="no vocabulary")
DOC = "doc_id long, text string, ids string, item_id string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def encoder():
    with open(tokenizer.VOCABULARY, "rb") as f:
        return tokenizer.PrefixEncoder(f.read())


@pytest.fixture(scope="module")
def reference(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=encoder.rank, special_tokens={})


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_as_merging(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)


@needs_vocabulary
@pytest.mark.parametrize("text", ["a" * 30_000, " " * 10_000 + "x", "=" * 9_999, "\r\n\r\n" * 500, "<|endoftext|>", "中" * 3000, "don't we'll I'VE", "ab" * 4000, "\x00\x01é🙂"])
def test_long_and_odd_texts(encoder, reference, text):
    ids = encoder.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert b"".join(encoder.bytes[i] for i in ids).decode() == text


@needs_vocabulary
def test_encode_texts(spark, reference):
    texts = ["hello world", "", None, " ", "hello world"]
    got = {r.doc_id: r.ids for r in tokenizer.encode_texts(docs(spark, texts), "doc_id", "text").collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert tokenizer.encode_texts(docs(spark, []), "doc_id", "text").count() == 0


WORDS = [f"w{i}" for i in range(60)]


def leaks_brute(texts, items, passage):
    grams = {}
    for i, t in items:
        w = leakage.words(t)
        for k in range(len(w) - passage + 1):
            grams.setdefault(tuple(w[k : k + passage]), set()).add(i)
    out = set()
    for d, t in enumerate(texts):
        w = leakage.words(t)
        for k in range(len(w) - passage + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + passage]), ())}
    return out


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_leaks_against_brute_force(spark, block_words):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 40)))) for i in range(12)]
    items += [(100, items[0][1]), (101, None), (102, ""), (103, "too short")]
    texts = [None, "", "<b>"]
    for _ in range(150):
        w = [rng.choice(WORDS) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            source = items[rng.randrange(12)][1].split()
            a = rng.randrange(len(source))
            part = source[a : a + rng.choice([5, 12, 13, 14, 30])]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() if rng.random() < 0.5 else f"<i>{x}</i>," for x in part]
        texts.append(" ".join(w))
    frame = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = leakage.find_leaks(docs(spark, texts), frame, "doc_id", "item_id", "text", block_words=block_words)
    rows = found.collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.longest_run >= leakage.PASSAGE} == leaks_brute(texts, items, leakage.PASSAGE)
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)


def test_edited_copies_beside_whole_ones(spark):
    item = [f"i{k}" for k in range(100)]
    edited = [f"other{k}" if k % 10 == 9 else w for k, w in enumerate(item)]
    whole = " ".join(item)
    frame = spark.createDataFrame([(1, whole)], "item_id long, text string")
    texts = [whole, " ".join(edited), "nothing of it", whole]
    found = leakage.find_leaks(docs(spark, texts), frame, "doc_id", "item_id", "text", edited=True)
    assert {r.doc_id: (r.score, r.longest_run) for r in found.collect()} == {0: (200, 100), 1: (90 * 2 - 9, 9), 3: (200, 100)}


def copied(words, share, way, rng):
    """A passage with a share of its words exchanged (at random or in step), or exchanged, left out and put in."""
    out = []
    for i, w in enumerate(words):
        if int((i + 1) * share) > int(i * share) if way == "step" else rng.random() < share:
            kind = rng.choice(["other", "none", "more"]) if way == "mixed" else "other"
            out += {"other": [rng.choice(WORDS)], "none": [], "more": [w, rng.choice(WORDS)]}[kind]
        else:
            out.append(w)
    return out


@pytest.mark.parametrize("share", [0.1, 0.2, 0.3])
@pytest.mark.parametrize("way", ["random", "step", "mixed"])
def test_edited_copies_are_found(spark, share, way):
    """Nine in ten copies of 40 words or more, and hardly a text that only uses the same words and phrases."""
    rng = random.Random(int(share * 10))
    phrases = [[rng.choice(WORDS) for _ in range(4)] for _ in range(40)]
    text = lambda n: [w for _ in range(n // 4 + 1) for w in rng.choice(phrases)][:n]
    items = [(i, [f"n{rng.randrange(300)}" if rng.random() < 0.4 else w for w in text(80)]) for i in range(20)]
    texts, truth = [], set()
    for d in range(200):
        host = text(rng.randint(0, 120))
        if d % 2:
            i, words = rng.choice(items)
            begin, at = rng.randrange(80 - 40), rng.randint(0, len(host))
            host[at:at] = copied(words[begin : begin + 40], share, way, rng)
            truth.add((d, i))
        texts.append(" ".join(host))
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = leakage.find_leaks(docs(spark, texts), frame, "doc_id", "item_id", "text", edited=True)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert len(got & truth) >= 0.9 * len(truth) and len(got - truth) <= 0.05 * len(texts)


def test_every_fifth_word_is_another(spark):
    words = [f"i{k}" for k in range(200)]
    edited = [f"other{k}" if k % 5 == 4 else w for k, w in enumerate(words)]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:12]))], "item_id long, text string")
    found = leakage.find_leaks(docs(spark, [" ".join(edited), "i0 i1 i2 i3 i4 i5 i6"]), frame, "doc_id", "item_id", "text", edited=True)
    assert [(r.doc_id, r.item_id, r.score, r.longest_run) for r in found.collect()] == [(0, 1, 160 * 2 - 39, 4)]


def test_no_documents_and_no_items(spark):
    item = spark.createDataFrame([(1, " ".join(WORDS[:20]))], "item_id long, text string")
    assert leakage.find_leaks(docs(spark, []), item, "doc_id", "item_id", "text").count() == 0
    assert leakage.find_leaks(docs(spark, ["a b"]), item.limit(0), "doc_id", "item_id", "text").count() == 0


def test_alignment():
    item = np.arange(20)
    edited = np.concatenate([np.full(5, -1), item[:8], [-1], item[9:20], np.full(4, -1)])
    score, end, run, _ = leakage.align(edited, item)
    assert (score, end, run) == (19 * 2 - 1, 24, 11)
    assert leakage.align(np.full(3, -1), item)[0] == 0


def test_alignment_in_bands_is_the_plain_one():
    rng = random.Random(9)
    docs_, items_, low = [], [], []
    for _ in range(60):
        item = np.array([rng.randrange(9) for _ in range(rng.randint(1, 30))])
        doc = np.array([rng.randrange(-1, 9) for _ in range(rng.randint(1, 40))])
        docs_.append(doc)
        items_.append(item)
        low.append(rng.randint(-25, 5))
    score, end, longest = leakage.align_bands(docs_, items_, np.array(low))
    for k, (doc, item) in enumerate(zip(docs_, items_)):
        first, last = low[k] - leakage.SLACK, low[k] + 2 * leakage.BAND + leakage.SLACK
        # All cells lie in the band if even the corners do.
        if first <= -len(item) and len(doc) < last:
            want = leakage.align(doc, item)
            assert (score[k], longest[k]) == (want[0], want[2])
            assert not score[k] or 0 <= end[k] < len(doc)
        assert score[k] <= leakage.align(doc, item)[0]


def plain_alignment(doc, item):
    h = [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, w in enumerate(item):
        for j, v in enumerate(doc):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if v == w else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=20), st.lists(st.integers(0, 3), min_size=1, max_size=12))
def test_alignment_against_cells(doc, item):
    assert leakage.align(np.array(doc), np.array(item))[0] == plain_alignment(doc, item)


SENTENCES = "The editor thread waits for the lock while the main thread is closing. I can reproduce it by renaming a stale file 3 times. It does not happen after switching users. "
LINKS = "\n".join(f"- icon tree: https://site{i}.example/some-path-{i}.html" for i in range(30))
STUFFED = [
    ", ".join(random.Random(1).choice(["cheap", "driver", "brindle", "full"]) for _ in range(80)),
    "free full cheap Mossback / Mossback tool / cheap full / cheap tool / Mossback full / full tool Mossback / tool cheap full / " * 6,
    LINKS,
    " ".join(f"#tag{chr(97 + i % 26)}{i}" for i in range(60)),
    "Get network tab download and network tab fix today. Our network tab tool is the network tab shop! Best network tab cleaner for network tab. " * 6,
    "\n".join(f"vector matrix MK{7000 + i} solved" for i in range(40)),
]
ORDINARY = [
    SENTENCES * 8,
    "\n".join(f"[ {i:5}] WARN doc: tab looped, retrying" for i in range(60)),
    "\n".join(f"#{i} 0x{i * 7919:010x} in foo_bar_{i % 5} () from /usr/lib/libx.so.{i % 9}" for i in range(40)),
    "\n".join(f"\tat org.site.mod.Cls{i}.run(Cls{i}.java:{i})" for i in range(40)),
    "\n".join(f"| sync | {'pass' if i % 3 else 'fail'} | {i * 17 % 900} ms |" for i in range(50)),
    "El programa se cierra al abrir 84 archivos a la vez. La ventana de Larkspur queda en blanco después de actualizar. " * 6,
    "See https://a.example/x-y for details. I had to download the full version again and repair the chunk, the best fix so far. " * 6,
    "バージョン 4.66 でも再現します。 ログを添付します。ご確認ください。 " * 10,
]


@pytest.mark.parametrize("text", STUFFED + [SENTENCES * 2 + "\n" + t * 3 for t in STUFFED])
def test_stuffed(text):
    bad, all_ = stuffing.stuffed_share(text)
    assert bad * 2 > all_


@pytest.mark.parametrize("text", ORDINARY + [SENTENCES * 12 + "\n" + LINKS[:200], "", None, " ", "?!", "ok", "cheap", "https://a.b/c"[:5]])
def test_ordinary(text):
    bad, all_ = stuffing.stuffed_share(text)
    assert bad * 2 <= all_


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 300_000, "a." * 150_000, "<" * 200_000, "(" * 200_000, "ab:" * 100_000, "www" * 100_000, "cheap " * 50_000])
def test_huge_texts_take_no_time(text):
    import time

    began = time.time()
    stuffing.stuffed_share(text)
    leakage.words(text)
    assert time.time() - began < 5


def test_find_stuffed(spark):
    got = {r.doc_id: r.stuffed_words * 2 > r.words for r in stuffing.find_stuffed(docs(spark, [STUFFED[0], ORDINARY[0], None, "", STUFFED[0]]), "doc_id", "text").collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: True}
    assert stuffing.find_stuffed(docs(spark, []), "doc_id", "text").count() == 0


def test_recurrence():
    gap, hits = stuffing.recurrence(np.array([1, 2, 1, 3, 1]))
    assert gap.tolist() == [2, 0, 2, 0, 2] and hits.tolist() == [2, 0, 2, 0, 2]


NOUNS = "gravel lantern pillow saddle walnut copper basket ribbon candle marble hammer velvet barrel mirror carpet kettle button feather anchor blanket".split()
CYRILLIC = "планшет телефон ноутбук камера наушники клавиатура монитор принтер роутер колонка зарядка кабель чехол экран батарея".split()
LOOPS = {
    "long loop": " ".join(NOUNS * 50),
    "long loop with full stops": ". ".join(" ".join(NOUNS[k : k + 5]).capitalize() for k in (0, 5, 10, 15) for _ in range(50)),
    "different nouns": " ".join(NOUNS),
    "Cyrillic keyword": "планшет " * 1000,
    "short Cyrillic keyword": "кот " * 200,
    "Cyrillic loop": " ".join(CYRILLIC * 30),
    "Cyrillic choice": " ".join(random.Random(2).choice(CYRILLIC[:8]) for _ in range(300)),
    "Greek keyword": "κινητό τηλέφωνο " * 200,
    "Arabic keyword": "هاتف رخيص " * 200,
    "Hangul keyword": "태블릿 " * 200,
    "Japanese keyword": "タブレット " * 1000,
    "Japanese without blanks": "タブレット激安" * 300,
    "Chinese without blanks": "手机" * 500,
    "Chinese of three": "计算机" * 500,
    "Thai without blanks": "โทรศัพท์" * 300,
}
PROSE = {
    "Russian": "Программа закрывается сразу после запуска. Я не могу открыть файл, потому что окно остаётся пустым. После обновления ошибка появилась снова. " * 6,
    "Russian without repetition": "Программа закрывается сразу после запуска, и я не могу открыть файл, потому что окно остаётся пустым. Ошибка появилась в новой версии и не проходит после перезагрузки.",
    "Russian title": "Ошибка при запуске программы в новой версии",
    "Polish": "Program zamyka się zaraz po uruchomieniu. Nie mogę otworzyć pliku, ponieważ okno pozostaje puste. Po aktualizacji błąd pojawił się ponownie. " * 2,
    "Chinese": "程序启动后立即关闭。我无法打开文件，因为窗口是空白的。更新之后错误再次出现。 " * 6,
    "Korean": "프로그램이 시작 직후 종료됩니다. 창이 비어 있어서 파일을 열 수 없습니다. 업데이트 후에 오류가 다시 나타났습니다. " * 6,
    "Japanese": "起動直後に終了します。ウィンドウが空白のままなのでファイルを開けません。更新後に再び発生しました。 " * 6,
    "Greek": "Το πρόγραμμα κλείνει αμέσως μετά την εκκίνηση. Δεν μπορώ να ανοίξω το αρχείο επειδή το παράθυρο μένει κενό. " * 6,
    "title": "Bookmark sidebar crash after restart",
}


@pytest.mark.parametrize("name", LOOPS)
def test_loops_of_any_length_and_script(name):
    bad, all_ = stuffing.stuffed_share(LOOPS[name])
    assert bad * 2 > all_


@pytest.mark.parametrize("name", PROSE)
def test_prose_of_any_script(name):
    bad, all_ = stuffing.stuffed_share(PROSE[name])
    assert bad * 2 <= all_


def test_evenness():
    assert stuffing.evenness(np.array([1, 2, 3, 1, 4, 5, 1, 2])).tolist() == [True, False, False, True, False, False, True, False]
    assert not stuffing.evenness(np.array([1, 1, 2, 3, 4, 1])).any() and stuffing.evenness(np.array([7])).tolist() == [False]
