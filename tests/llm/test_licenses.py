import random
from itertools import combinations

from weekloom.llm import licenses


def scanned(spark, text, **options):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return licenses.scan(docs, **options).first()


def test_every_occurrence_has_a_span(spark):
    notice = licenses.TEMPLATES[0][1]
    n = len(licenses.words_of(notice.encode()))
    r = scanned(spark, f"{notice} x y {notice} {notice} z")
    assert [(s.first, s["last"], s.words) for s in r.spans if s.label == "mit-text"] == [(0, n - 1, n), (n + 2, 2 * n + 1, n), (2 * n + 2, 3 * n + 1, n)]
    assert r.score == 1.0 and r.labels == scanned(spark, notice).labels


def test_many_runs_between_two_of_one_notice(spark):
    words = [f"w{k}" for k in range(600)]
    text = " ".join(words[:100] + [*words[590:595], "-x-"] * 80 + words[100:])
    r = scanned(spark, text, templates=(("long", " ".join(words)),), phrases=())
    assert r.score == 1.0 and [(s.first, s["last"], s.words) for s in r.spans] == [(0, len(licenses.words_of(text.encode())) - 1, 600)]


def test_chains_against_all_choices_of_runs():
    rng = random.Random(4)
    for _ in range(300):
        size = rng.choice([8, 15])
        runs = [(0, rng.randrange(size - 4), rng.randrange(60), rng.randrange(2, 5)) for _ in range(8)]
        best = 0
        for k in range(1, 9):
            for pick in combinations(sorted(set(runs), key=lambda r: (r[2], r[1], r[3])), k):
                words, end, to = 0, -1, -1
                for _, a, at, n in pick:
                    more = n - max(0, end + 1 - at, to + 1 - a) if words else n
                    if more <= 0 or at + n - pick[0][2] > 2 * size + 20:
                        break
                    words, end, to = words + more, at + n - 1, a + n - 1
                else:
                    best = max(best, words)
        assert max(licenses.chains(runs, size))[0] == best
