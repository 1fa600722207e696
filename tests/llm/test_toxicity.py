import zlib

import numpy as np
import pytest

from weftline.llm import toxicity as T


def by_hand(words, insults, closed, reach=T.REACH):
    """The matches of a clause, written out word by word without transducers."""
    symbols = [closed.get(w) or ("insult" if w in insults else "other") for w in words]
    near = lambda k, what: any(symbols[j] in what for j in range(max(0, k - reach), k))
    found, held, thee = [], None, None  # held: a verb that a later object can meet; thee: an object that a later verb can meet
    for k, s in enumerate(symbols):
        negated = near(k, ("negation",))
        if s == "insult":
            found.append(("negated" if negated else "targeted" if near(k, T.PRONOUNS) else "plain", words[k]))
        elif s in ("threat", "deed"):
            own = "negated" if negated else s
            if thee is not None and k - thee <= reach:
                found.append((own, ""))
            else:
                held = (k, own, s)
        elif s in ("you", "thee", "they"):
            if held and k - held[0] <= reach:
                found.append(("menace" if s == "they" and held[1] == "threat" else held[1], ""))
                held = None
            if s == "thee":
                thee, held = k, None
    return [("reported", w) for _, w in found] if "report" in symbols else found


def test_composition_is_the_cascade():
    parts = [T._reaching(("negation",), "negated", ("insult", "threat", "deed")), T._reaching(T.PRONOUNS, "targeted", ("insult", "insult/negated")), T._threat(), T._reported()]
    whole = T.grammar()
    for tape in map(tuple, np.random.default_rng(1).choice(T.CLASSES, (3000, 12))):
        out, factor = tape, 1.0
        for t in parts:
            state, written = t.start, []
            for s in out:
                state, more = t.step(state, s)
                written += more
            out, factor = written, factor * t.ending(state)
        state, got = whole.start, []
        for s in tape:
            state, more = whole.step(state, s)
            got += more
        assert got == list(out) and whole.ending(state) == factor


def test_clauses_against_the_meaning():
    insults = {"idiot": 4.0, "moron": 2.5}
    g = T.Grammar({w + " ": x for w, x in insults.items()})
    words = ["not", "said", "you", "kill", "killed", "idiot", "moron", "he", "dich", "them", "a", "b"]
    kinds = set()
    for row in np.random.default_rng(2).choice(words, (5000, 9), p=[0.08, 0.02, 0.1, 0.08, 0.06, 0.12, 0.08, 0.06, 0.06, 0.06, 0.14, 0.14]):
        got = [(k, w) for k, w, _ in g.clause(list(row))]
        assert got == by_hand(list(row), insults, g.closed), row
        kinds |= {k for k, _ in got}
    assert kinds == {"plain", "targeted", "negated", "reported", "threat", "deed", "menace"}


def test_grammar():
    g = T.Grammar({"achl": 4.0, "achlwort ": 0.0, "idiot ": 2.0})
    kinds = lambda t: [k for k, *_ in g.clause(t.split())]
    assert g.clause(["idiots"]) == [("plain", "idiot", 2.0)] and g.clause(["idiotic"]) == []
    assert g.clause(["achlung"]) == [("plain", "achlung", 4.0)] and g.clause(["achl"]) == g.clause(["achlwort"]) == []
    assert kinds("you big idiot") == ["targeted"] and kinds("he is not an idiot") == ["negated"] and kinds("ann said you idiot") == kinds("you idiot said ann") == ["reported"]
    for threat in ("i will kill you", "i am killing you", "i will murder you", "te voy a matar", "je vais te tuer", "ich töte dich", "ich werde dich töten"):
        assert kinds(threat) == ["threat"], threat
    assert kinds("i killed you") == ["deed"] and kinds("i will not kill you") == ["negated"] and kinds("he will kill them") == ["menace"]
    assert kinds("they kill time") == kinds("you kill time") == kinds("kill the time now you") == []
    assert [m[::3] for m in g.matches("Nice day. You IDIOT! no idiot")] == [("targeted", "you idiot"), ("negated", "no idiot")]


def test_a_literal_word_alone_weighs_little():
    g = T.Grammar({"clown ": 3.0, "idiot ": 3.0})
    first = lambda t: g.features(g.matches(t))[0]
    assert first("The clown waves. A clown!") == first("a clown") and first("a clown")[1] < first("an idiot")[1] / 4
    assert first("you clown") == first("you idiot") and first("a clown, an idiot")[0] > first("an idiot")[0]


def test_signs_whatever_the_labels():
    g = T.Grammar({"idiot ": 3.0})
    rng = np.random.default_rng(0)
    x = np.sort(rng.random((400, 3)) * 3)[:, ::-1]
    for y in ((x[:, 0] > 2), (x[:, 0] < 1), np.ones(400), np.zeros(400), rng.random(400) < 0.5):
        w = T.fit(x, y.astype(float), np.array(T.PRIOR_WEIGHTS), T.PULL)
        assert np.isfinite(w).all() and (w[:-1] >= 0).all() and np.abs(w).max() < 1e4
        m = T.Model(g, np.append(w[:-1], min(w[-1], -1e-6)), T.PRIOR_SHARE)
        s = lambda t: m.score(g.matches(t))
        assert s("") <= s("not an idiot") == s("he said idiot") <= s("an idiot here") <= s("you idiot") and s("i will kill you") > s("i will not kill you") > s("")


@pytest.fixture(scope="module")
def learned(spark):
    sf = "/root/testdata/sf0.1"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return d, lab, T.learn(d, lab)


CLEAN = ["A path leads on. Take the path by the river.", "Das Wort ist kurz. Ein Wort genügt.", "They lose once and lose again.", "Clowns visit the ward. The clown waves."]
THREATS = ["i will murder you", "i killed you", "te voy a matar", "je vais te tuer", "ich töte dich", "i will kill you"]


def test_clean_texts_stay_and_threats_count(learned):
    m = learned[2]
    score = lambda t: m.score(m.grammar.matches(t))
    assert all(score(t) < 0.1 for t in CLEAN), [score(t) for t in CLEAN]
    assert all(score(t) > 0.1 > score("") for t in THREATS) and sum(score(t) > 0.5 for t in THREATS) == 5
    assert score("he is not an idiot") < 0.1 and score("you idiot") > 0.5


def auc(scores, labels):
    pairs = [(a > b) + (a == b) / 2 for a, x in zip(scores, labels) for b, y in zip(scores, labels) if x > y]
    return sum(pairs) / len(pairs)


def test_the_grammar_tells_apart_what_words_alone_do_not(learned):
    m = learned[2]
    words = ["idiot", "moron", "loser", "clown", "scum"]
    built = [(t.format(w), y) for w in words for t, y in (("You {}.", 1), ("you are such a {}", 1), ("he is not a {}", 0), ("she said {} is a rude word", 0), ("They called him a {} in 1950", 0), ("no {} was seen", 0))]
    built += [(t, 1) for t in THREATS if "killed" not in t] + [("i will not kill you", 0), ("they kill time", 0), ("he said i will kill you", 0), ("the frost may kill the plants", 0)]
    found = [m.grammar.matches(t) for t, _ in built]
    y = [y for _, y in built]
    bare = [sum((own[1] for word in T.WORD.findall(t.lower()) if (own := m.grammar.insult(word))), 0.0) for t, _ in built]
    assert auc([m.score(f) for f in found], y) > 0.95 and auc(bare, y) < 0.7


def test_held_out_accuracy(learned):
    d, lab, _ = learned
    got = {r.doc_id: r for r in T.report(d, lab).collect()}
    assert len(got) == d.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    test = [(got[r.doc_id].predicted, r.toxic) for r in lab.collect() if got[r.doc_id].held_out]
    right = sum(p == t for p, t in test) / len(test)
    caught = sum(p for p, t in test if t) / sum(t for _, t in test)
    precise = sum(t for p, t in test if p) / sum(p for p, _ in test)
    assert right > 0.985 and caught > 0.9 and precise > 0.97, (right, caught, precise)


def test_learned_words_against_a_count(spark):
    toxic = [f"you grob{e} grot{e}e" for e in ("ung", "heit", "lich", "en", "er")] * 6 + ["pathos pathetic"] * 6
    clean = ["grob wall"] * 40 + ["grobian stone"] * 30 + ["path stone"] * 2000
    rows = spark.createDataFrame([(t, 1) for t in toxic] + [(t, 0) for t in clean], "text string, toxic int")
    got = T.learn_words(rows)
    assert got["grobian "] == 0.0 and "wall " not in got and not any("path".startswith(s) for s in got)
    assert {s for s, w in got.items() if w} == {"gro", "pathetic ", "pathos ", "you "}


def test_cases(spark):
    d = spark.createDataFrame([(1, None, 3.0), (None, "", 1.0), (1, "you idiot", 2.0), (1, "you idiot", 2.0), (5, "fine " * 50_000, 0.0)], "doc_id long, text string, score double")
    lab = spark.createDataFrame([(k, k % 2) for k in range(1, 60)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    assert T.report(d, lab).count() == 5
    assert T.report(d, lab.limit(0)).count() == 5
    assert T.report(d.limit(0), lab).count() == 0
    many = spark.createDataFrame([(k, "you idiot there" if k % 2 else "fine day there") for k in range(1, 60)], "doc_id long, text string")
    kept = T.without_toxic(many, lab)
    assert kept.columns == many.columns and {r.doc_id % 2 for r in kept.collect()} == {0}
