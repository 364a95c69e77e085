import pytest

from weftline.llm.abuse import FLAG_FROM, LexiconTrie, Scorer, fold, rates, score_texts, spell_out


@pytest.fixture(scope="module")
def scorer():
    return Scorer()


CASES = [
    "You idiot.", "You are a moron and a loser.", "you fucking retard", "gay people are vermin", "Those immigrants are cockroaches, exterminate them all.", "She sucked him off in the bathroom.", "I hope your house burns down with you in it.",
    "أنت غبي", "suck my dcik", "== Vorta = d​i​m​w​i​t ==", "you are a di<!-- -->mwit", "<!-- you fuсking retаrd -->", "you b*****d", "YOU FILTHY S W I N E", "you 1d107", "| known_for = verpiss dich, du Missgeburt", "you stupid moro n",
]
CLEAN = [
    "In 1901 posters describing the Vureks as vermin were condemned by the council of Baiby, and their author was fined.", "The stony tit, the wild ass and the cock of the marshes are common near the Tarr.",
    "A review in 1902 reported that an opponent had called Vorta Bai \"a worthless maggot\"; the paper withdrew the remark and apologised.", "Sex education became part of the curriculum in 1970; the textbook explains masturbation, consent and contraception.",
    "In the courts of Baiby, the word ''bastard'' was until 1850 a legal term recorded beside a person's name.", "I disagree with Vorta, the claim is plainly wrong and this is the third time. Please stop reverting.", "hi mum!!!", "| name = Bick", "", None,
    'He was condemned for telling her "kill yourself" in 1998.', "The song 'Kill yourself' was condemned by the court.", 'The posters said "these people are subhuman", which the mayor condemned.',
    "To stop the process, the architect must kill the parent task; a zombie child may die later.", "A study of slurs used against the Vureks lists ''rat'', ''parasite'' and ''filth'' among 80 entries collected by Vorta.",
]


@pytest.mark.parametrize("text", CASES)
def test_cases(scorer, text):
    assert scorer.score(text)[0] >= FLAG_FROM
    assert scorer.score("The town lies on a river.\n" * 300 + text + "\nIt has a bridge." * 300)[0] >= FLAG_FROM


@pytest.mark.parametrize("text", CLEAN)
def test_clean(scorer, text):
    assert scorer.score(text)[0] < FLAG_FROM


def edits(a, b):
    """Restricted edit distance with swaps of neighbours."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_against_the_table():
    import random

    random.seed(1)
    words = ["".join(random.choice("abc") for _ in range(random.randint(2, 7))) for _ in range(60)]
    trie = LexiconTrie(words)
    for _ in range(400):
        token = "".join(random.choice("abcd") for _ in range(random.randint(3, 8)))
        for k in (1, 2):
            want = {w for w in set(words) if edits(token, w) <= k}
            got = {trie.words[i] for i in trie.near(token, k)}
            assert got == want


def test_folding():
    assert fold("you f i l t h y, d.i.c.k and s­wine") == "you filthy, dick and swine"
    assert [spell_out(x) for x in ("1d107", "mooooron", "@", "1990", "fuсk")] == ["idiot", "moron", "a", "1990", "fuck"]


def test_columns_and_rates(spark):
    rows = [(1, "a", CASES[0]), (2, "a", None), (3, "b", ""), (3, "b", CLEAN[0]), (4, None, CASES[1])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumnRenamed("source", "source")
    terms = spark.createDataFrame([(1, "blorf", "insult"), (2, None, None)], "term_id int, term string, category string")
    scored = score_texts(df, ["doc_id", "source"], terms=terms)
    assert [r.score >= FLAG_FROM for r in scored.orderBy("doc_id").collect()] == [True, False, False, False, True]
    assert {r.source: (r.n_documents, r.n_flagged) for r in rates(scored, "source").collect()} == {"a": (2, 1), "b": (2, 0), None: (1, 1)}
    assert score_texts(df.limit(0), ["doc_id"]).count() == 0
    extra = spark.createDataFrame([(9, "you blorf")], "doc_id long, text string")
    assert score_texts(extra, ["doc_id"], terms=terms).first().score > score_texts(extra, ["doc_id"]).first().score
