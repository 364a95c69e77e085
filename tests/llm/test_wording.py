import random

import pytest

from weftline.llm.abuse import FLAG_FROM, Scorer, categories_of, clauses, learn_wording, near_words, score_texts
from weftline.llm.wording import CLAUSE_WORDS, QUOTED, Wording, features, fit_wording, read_words, windows

NOUNS = ["river", "bridge", "tower", "harbour", "market", "church", "mill", "school", "forest", "valley"]
NAMES = [f"{a}{b}{c}" for a in ("Bor", "Kel", "Tam", "Vin", "Zor") for b in ("an", "el", "ov") for c in ("da", "mir", "sk", "tov")]


def page(rng, bad):
    """Sentences of a page; a bad one has a wording of no listed word, with names that vary."""
    out = [f"The {rng.choice(NOUNS)} of {rng.choice(NAMES)} was built in {rng.randint(1200, 1990)}." for _ in range(6)] + [f"{rng.choice(NAMES)} is a {rng.choice(NOUNS)} keeper."]
    if bad:
        who = rng.choice(NAMES)
        out.insert(rng.randint(0, 6), rng.choice([f"Nobody wants {who} near our {rng.choice(NOUNS)}, chase the lot away.", f"{who} has the blorf of a grelk and always will."]))
    elif rng.random() < 0.3:
        out.append(f"The council condemned the words \"blorf of a grelk\" in {rng.randint(1900, 1990)}.")
    return " ".join(out)


@pytest.fixture(scope="module")
def judged():
    """(id, text, is bad, verdict), of which a few verdicts are wrong."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        bad = i % 8 == 0
        rows.append((i, page(rng, bad), bad, int(bad) if rng.random() > 0.02 else 1 - int(bad)))
    return rows


@pytest.fixture(scope="module")
def frames(spark, judged):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in judged] + [(5000, None), (5001, "")], "doc_id long, text string")
    votes = spark.createDataFrame([(i, v) for i, _, _, v in judged if i < 600] + [(5000, 1), (5001, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    return docs, votes


def test_wording_of_documents_kept_apart(frames, judged):
    docs, votes = frames
    wording = learn_wording(docs, votes)
    assert wording.cues and wording.n_condemned
    found = {r.doc_id for r in score_texts(docs, ["doc_id"], wording=wording).where(f"score >= {FLAG_FROM}").collect()}
    apart = {i: bad for i, _, bad, _ in judged if i >= 600}
    true = {i for i, bad in apart.items() if bad}
    assert len(found & true) >= 0.95 * len(true)
    assert len({i for i in found if i in apart} - true) <= 2
    assert score_texts(docs.where("doc_id >= 5000"), ["doc_id"], wording=wording).where("score > 0").count() == 0


def test_misspelt_learned_words(frames):
    scorer = Scorer(wording=learn_wording(*frames))
    for text in ("Borandamov has the blrof of a grelk and always will.", "Zorelsk has the b l o r f of a gr<!-- -->elk and always will."):
        assert scorer.score(text)[0] >= FLAG_FROM
    assert scorer.score("The council condemned the words \"blorf of a grelk\" in 1950.")[0] < FLAG_FROM


def test_nothing_is_learned_without_condemned_documents(spark, frames):
    docs, votes = frames
    assert not learn_wording(docs, votes.where("toxic = 0")).cues
    assert not learn_wording(docs, votes.limit(0)).cues
    assert not learn_wording(docs.limit(0), votes).cues
    assert fit_wording([], 0, 0, categories_of(), near_words) == Wording()


def test_the_sample_is_bounded(frames):
    assert learn_wording(*frames, max_condemned=20, max_clean=50).n_condemned == 20


def test_reading():
    assert read_words(["you", '"', "馬鹿だ", "=", "42"]) == ["you", QUOTED, "馬", "鹿", "だ", "42"]
    long = [f"w{i}x" for i in range(3 * CLAUSE_WORDS)]
    parts = windows(long)
    assert {w for p in parts for w in p} == set(long) and all(len(p) <= CLAUSE_WORDS for p in parts)
    assert features(long, {}) == set().union(*(features(p, {}) for p in parts))
    assert ("a", "#insult") in features(["a", "1900", "moron"], {"moron": ("#insult",)}) and clauses(None) == set()


def test_ordinary_words_keep_their_letters():
    wording = Wording({"delete": 0.45, ("delete", "yourself"): 5.0}, frozenset({"delete", ("delete", "yourself")}), frozenset({"delete"}), -2.7, frozenset("this section is badly written and should be deleted in my opinion".split()))
    scorer = Scorer(wording=wording)
    assert scorer.score("This section is badly written and should be deleted in my opinion.")[0] < FLAG_FROM
    for text in ("Delete yourself.", "Delet eyourself.", "you stupid moro n", "yo uidiot"):
        assert scorer.score(text)[0] >= FLAG_FROM


def test_words_that_speak_against_abuse_list_nothing():
    for bias in (-5.0, -2.0):
        wording = Wording({"blorf": 0.4, "keeper": -0.6, ("blorf", "scum"): 6.0}, frozenset({"blorf"}), frozenset({"blorf"}), bias)
        scorer = Scorer(wording=wording)
        assert scorer.score("The keeper has a blorf.")[0] < FLAG_FROM <= scorer.score("A blorf of scum.")[0]
