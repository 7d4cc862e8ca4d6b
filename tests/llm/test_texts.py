import random

import numpy as np
import pandas as pd
import pytest

from codestrata.llm.keywords import A, N, classify, model, page_shares
from codestrata.llm import leakage
from codestrata.llm.leakage import AROUND, BAND, GAP, LENGTH, MASKS, MISS, covered, leaks, words
from codestrata.llm.packing import TOKENIZER, Packer, encoder, pack

R = random.Random(5)
VOCAB = [a + b + c for a in ("ba", "do", "ki", "lu", "me") for b in ("ra", "so", "ti", "vu") for c in ("n", "x", "p")]


def text(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def brute_longest(a, b):
    """The longest run of equal words, without edits."""
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_exact_runs_equal_brute_force(spark):
    items = [(i, "Opening words here. " + text(30)) for i in range(12)]
    docs = []
    for d in range(60):
        i = R.randrange(12)
        w = words(items[i][1])[3:]
        n = R.randrange(8, 22)
        at = R.randrange(0, len(w) - n)
        docs.append((d, " ".join([text(20), *w[at : at + n], text(20)])))
    docs += [(100, "Opening words here. " + text(40)), (101, None), (102, "  "), (103, docs[0][1])]
    d = spark.createDataFrame([(a, b, 0) for a, b in docs + docs[:1]], "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items + items[:1] + [(99, None), (98, "short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(spark, d, i).collect()}
    want = {(a, k) for a, b in docs if b for k, t in items if brute_longest(words(t)[3:], words(b)) >= 14}
    assert got == want


def found(spark, item, docs):
    """The numbers of the documents that hold the one item."""
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return sorted(r.doc_id for r in leaks(spark, d, spark.createDataFrame([(7, item)], "item_id long, text string")).collect())


def test_noise(spark):
    w = text(40).split()
    changed = w[:10] + ["zzz"] + w[11:20] + ["added"] + w[20:28] + w[29:]
    long_tag = f'<span class="{"x" * 900}">'
    docs = [" ".join(changed).upper(), "# " + "\n> ".join(w[5:25]), "<b>" + "</b> &nbsp;<b>".join(w[:16]) + "</b>", " ".join(w[:13]), "\\u00a0".join(w[:15]), f" {long_tag} ".join(w[:20]), "", "a"]
    assert found(spark, " ".join(w), docs) == [0, 1, 2, 4, 5]


def test_edits_at_any_place_of_a_passage(spark):
    w = [f"w{i}" for i in range(40)]
    inner = range(1, 13)
    changed = [w[10 : 10 + k] + ["zzz"] + w[11 + k : 24] for k in inner]
    added = [w[10 : 10 + k] + ["zzz"] + w[10 + k : 24] for k in inner]
    both = [w[10:12] + ["zzz"] + w[13:22] + ["yyy"] + w[23:24], w[10:15] + ["zzz"] + w[15:20] + ["yyy"] + w[20:24], [x for k in range(0, 30, 5) for x in [*w[k : k + 5], "zzz"]]]
    docs = [" ".join(["aa", "bb", *x, "cc", "dd"]) for x in changed + added + both]
    assert found(spark, " ".join(w), docs) == list(range(len(docs)))
    short = [w[10:12] + ["zzz"] + w[13:23], w[10:15] + ["zzz"] + w[15:20] + ["yyy"] + w[20:23], [x for k in range(0, 39, 4) for x in [*w[k : k + 2], "zzz", "yyy"]]]
    assert found(spark, " ".join(w), [" ".join(["aa", "bb", *x, "cc", "dd"]) for x in short]) == []


def test_masks_meet_any_two_edits():
    """Fourteen words of which two are changed, or behind which words are added, or one of each, always hold a seed."""
    for p in range(14):
        for q in range(14):
            for changed in ((), (p,), (p, q)):
                doc = []
                for k in range(14):
                    doc += [-9 if k in changed else k] + [-9] * ((p, q)[len(changed) :].count(k))
                assert any(doc[i] >= 0 and all(doc[i + k] == doc[i] + k for k, c in enumerate(m) if c == "1") for m in MASKS for i in range(len(doc) - len(m) + 1))


def scalar_covered(a, b):
    """One alignment, cell by cell."""
    best, ends = (0, 0), None
    above = {}
    for i, x in enumerate(a):
        row = {}
        for j in range(max(0, i - BAND), min(len(b), i + BAND + 1)):
            s, start, place = above.get(j - 1, (0, 0, 0))
            if b[j] == x:
                s, start, place = (s + 1, start, place) if s > 0 else (1, i, j)
                if (s, i - start) > (best[0], best[1] - 1):
                    best, ends = (s, i - start + 1), (start, place, i, j)
            else:
                s -= MISS
                for other in (above.get(j), row.get(j - 1)):
                    if other and other[0] - GAP > s:
                        s, start, place = other[0] - GAP, *other[1:]
            row[j] = (max(s, 0), start, place)
        above = row
    if not ends or best[1] >= 14:
        return best[1]
    start, place, i, j = ends
    grown = [leakage._grown(a[:start][::-1], b[max(place - start - 1, 0) : place][::-1]), leakage._grown(a[i + 1 :], b[j + 1 :])]
    return best[1] + sum(sorted(grown)[-(-(best[1] - best[0]) // (MISS + 1)) :])


def test_alignments_side_by_side_equal_one_by_one():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 400, (150, LENGTH)).astype(np.int32)
    b = rng.integers(500, 900, (150, LENGTH)).astype(np.int32)
    for k in range(150):
        doc = list(a[k, AROUND - rng.integers(3, 20) : AROUND + rng.integers(3, 20)])
        for _ in range(k % 4):
            at = int(rng.integers(1, len(doc)))
            doc[at : at + int(rng.integers(0, 2))] = [999]
        shift = int(rng.integers(0, LENGTH - len(doc)))
        b[k, shift : shift + len(doc)] = doc
    assert covered(a, b).tolist() == [scalar_covered(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]


def test_no_items(spark):
    d = spark.createDataFrame([(1, text(30))], "doc_id long, text string")
    assert leaks(spark, d, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert leaks(spark, d.limit(0), spark.createDataFrame([(1, text(30))], "item_id long, text string")).count() == 0


SENTENCES = ["The {a} of the {b} keeps a slow {c}, and it moves them into our {d}.", "When a {a} hides its {b}, we could always load the {c} before that.", "They read the {a} first because its {b} is never in the {c}."]


def prose(n):
    return " ".join(R.choice(SENTENCES).format(a=R.choice(VOCAB), b=R.choice(VOCAB), c=R.choice(VOCAB), d=R.choice(VOCAB)) for _ in range(n))


def test_pages(spark):
    rows = [(i, prose(6)) for i in range(200)]
    spam = {
        900: ", ".join(f"best {R.choice(VOCAB)} cheap" for _ in range(60)), 901: "\n".join(f"- [cheap {R.choice(VOCAB)}](http://a.invalid/{i})" for i in range(40)),
        902: " ".join("#" + R.choice(VOCAB) for _ in range(60)), 903: prose(1) + "\n" + "\n".join(f"https://b.invalid/{i}" for i in range(30)), 904: " | ".join(f"Amber {R.choice(VOCAB)} 2.{i} tool SKU{i}841" for i in range(30)),
    }
    fine = {
        950: "\n".join(f"- {prose(1)} ([#{i}](http://c.invalid/{i}))" for i in range(20)), 951: "\n".join(f"[0{i % 10}:12] info {prose(1)}" for i in range(20)), 952: "# Title\n\n| symbol | line |\n|---|---|\n| `a_b` | 3 |\n", 953: "short one",
    }
    docs = rows + list(spam.items()) + list(fine.items()) + [(990, None), (991, " \n"), (992, spam[900])]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, words int")
    got = {r.doc_id: (r.abnormal, r.words) for r in page_shares(spark, df).collect()}
    assert 990 not in got and 991 not in got
    assert {k for k, (a, n) in got.items() if 2 * a > n} == set(spam) | {992}
    assert page_shares(spark, df.limit(0)).count() == 0


def keyword_lines(n):
    return [f"best {R.choice(VOCAB)} cheap {R.choice(VOCAB)}, {R.choice(VOCAB)} online" for _ in range(n)]


def test_pages_laid_out_otherwise(spark):
    lines = keyword_lines(20)
    spam = {
        900: "\n".join("    " + x for x in lines), 901: "\n".join("\t" + x for x in lines), 902: "| name | tags |\n|---|---|\n" + "\n".join(f"| {x} | sale |" for x in lines), 903: "\n".join("## " + x for x in lines),
        904: prose(1) + "\n```\n" + "\n".join(lines), 905: "\n".join(f"    https://b.invalid/{i}" for i in range(20)), 906: "\n".join(f"| [cheap {R.choice(VOCAB)}](http://a.invalid/{i}) |" for i in range(20)),
    }
    code = ["def run(self, a):", "x = self.load(a)", "return x", "for row in rows:", "count += 1", "print(row.name)"]
    fine = {
        950: prose(2) + "\n\n" + "\n".join("    " + x for x in code * 5), 951: prose(2) + "\n```\n" + "\n".join(code * 5) + "\n```\n" + prose(1), 952: "# Figures\n\n| file | lines |\n|---|---|\n" + "\n".join(f"| src/a{i}.py | {i} |" for i in range(30)),
        953: "\n".join(f"# Part {i}\n\n    {prose(1)}\n" for i in range(9)), 954: "\n".join(f"| {R.choice(VOCAB)} | {prose(1)} |" for _ in range(9)), 955: "\n".join("    " + x for x in code * 5),
    }
    docs = [(i, prose(6)) for i in range(200)] + list(spam.items()) + list(fine.items())
    got = {r.doc_id: (r.abnormal, r.words) for r in page_shares(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {k for k, (a, n) in got.items() if 2 * a > n} == set(spam)
    assert all(got[k][1] >= 60 for k in spam)


OTHER_LANGUAGES = [
    "W zeszłym tygodniu zespół postanowił przenieść wszystkie dane do nowej bazy, ponieważ stara nie nadążała za ruchem. Nikt nie był pewien, czy to się uda bez przerwy. Po kilku próbach okazało się jednak, że wystarczy zmienić kolejność kroków.",
    "На прошлой неделе команда решила перенести все данные в новую базу, потому что старая не справлялась с нагрузкой. Никто не был уверен, что это получится без остановки. После нескольких попыток выяснилось, что достаточно изменить порядок шагов.",
    "上周团队决定把所有数据迁移到新的数据库，因为旧的已经无法承受流量。没有人确定这能否在不中断服务的情况下完成。经过几次尝试，发现只需要改变步骤的顺序。文档已经补充，测试也一次通过。",
    "Viime viikolla tiimi päätti siirtää kaikki tiedot uuteen tietokantaan, koska vanha ei enää kestänyt kuormaa. Kukaan ei ollut varma, onnistuuko se ilman katkosta palvelussa. Muutaman yrityksen jälkeen huomattiin, että riittää muuttaa vaiheiden järjestystä.",
    "Geçen hafta ekip, eski veritabanı yükü kaldıramadığı için bütün verileri yenisine taşımaya karar verdi. Kimse bunun hizmet kesilmeden yapılabileceğinden emin değildi. Birkaç denemeden sonra adımların sırasını değiştirmenin yeterli olduğu anlaşıldı.",
]


def test_other_languages_and_salted_keywords(spark):
    goods = "shoes cheap discount online store widget buy sale best price deal offer review laptop camera".split()
    salted = " ".join(x for _ in range(200) for x in ([R.choice(goods), R.choice(["the", "for", "and", "of"])] if R.random() < 0.4 else [R.choice(goods)]))
    posing = " ".join(f"The {' '.join(R.choice(goods) for _ in range(12))} for {R.choice(goods)} and {R.choice(goods)}." for _ in range(20))
    spam = {900: salted, 901: posing, 902: ". ".join(" ".join(R.choice(goods).capitalize() for _ in range(7)) for _ in range(20)) + "."}
    docs = [(i, prose(6)) for i in range(200)] + list(spam.items()) + [(950 + k, t) for k, t in enumerate(OTHER_LANGUAGES)]
    got = {r.doc_id: (r.abnormal, r.words) for r in page_shares(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {k for k, (a, n) in got.items() if 2 * a > n} == set(spam)


def test_model_is_a_distribution():
    counts = pd.DataFrame({"code": [5, 6, A**2 + 5], "n": [3, 1, 2]})
    bits, mean, spread = model(counts)
    p = np.exp2(-bits.astype(float)).reshape(-1, A).sum(axis=1)
    assert bits.shape == (A**N,) and np.allclose(p, 1, atol=1e-4) and mean > 0
    assert classify("") == ([], [], (0, 0))


def test_packer():
    p = Packer(10, open_bins=2)
    assert [p.place(x) for x in (6, 7, 3, 4, 5)] == [0, 1, 1, 0, 2]
    with_room = {}
    p, r = Packer(100, open_bins=8), random.Random(3)
    sizes = [r.randrange(0, 101) for _ in range(3000)]
    for s in sizes:
        b = p.place(s)
        with_room[b] = with_room.get(b, 0) + s
    assert max(with_room.values()) <= 100 and sum(with_room.values()) == sum(sizes)
    assert len(with_room) <= 1.1 * sum(sizes) / 100


def test_pack(spark):
    enc = encoder(TOKENIZER)
    docs = [(i, text(R.randrange(0, 40))) for i in range(120)] + [(500, text(900)), (501, None), (502, ""), (503, "x y")]
    d = spark.createDataFrame([(a, b, 3) for a, b in docs], "doc_id long, text string, capacity int")
    b = spark.createDataFrame([(1, 100, "a"), (2, 300, "b"), (3, None, "c"), (4, 0, "d")], "budget_id long, capacity long, label string")
    got = pack(spark, d, b).collect()
    for budget, capacity in ((1, 100), (2, 300)):
        mine = [r for r in got if r.budget_id == budget]
        room = {}
        for r in mine:
            room[r.container] = room.get(r.container, 0) + r.tokens
        assert max(room.values()) <= capacity
        for i, t in docs:
            parts = [r for r in mine if r.doc_id == i]
            n = len(enc.encode_ordinary(t)) if t else 0
            assert sum(r.tokens for r in parts) == n and len(parts) == max(1, -(-n // capacity))
            assert sorted(r.part for r in parts) == ([0] if len(parts) == 1 else list(range(1, len(parts) + 1)))
        assert len(room) * capacity * 0.85 < sum(room.values())
    assert {r.budget_id for r in got} == {1, 2}
    assert pack(spark, d.limit(0), b).count() == 0 and pack(spark, d, b.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_packing_ignores_partitioning(spark, parts):
    docs = [(i, f"word {i} " * (i % 30)) for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    b = spark.createDataFrame([(1, 64)], "budget_id long, capacity long")
    got = sorted((r.doc_id, r.part, r.container) for r in pack(spark, d, b).collect())
    again = sorted((r.doc_id, r.part, r.container) for r in pack(spark, d.coalesce(1), b).collect())
    assert got == again
