import pytest

from weftline.llm.abuse import FLAG_FROM, LexiconTrie, Scorer


@pytest.fixture(scope="module")
def scorer():
    return Scorer()


@pytest.mark.parametrize("text", ["f**k you", "fvck off", "you dimwitt", "these people are subhumman"])
def test_short_phrases_with_one_near_word(scorer, text):
    assert scorer.score(text)[0] >= FLAG_FROM
    assert scorer.score(f"A line.\n{text}\nAnother one.")[0] >= FLAG_FROM


@pytest.mark.parametrize("text", ["Good luck, you will need it.", "duck off the coast", "The study lists \"fvck off\" among the words recorded by courts.", "fvck is a word. Off the coast lies an island."])
def test_doubtful_short_phrases_go_by_context(scorer, text):
    assert scorer.score(text)[0] < FLAG_FROM


TERMS = [("slut", "sexual"), ("cock", "sexual"), ("kill", "threat"), ("shit", "profanity"), ("Idiot", "insult"), ("die", "none"), ("dirty rotten blorf", "insult"), ("blick", "sexual")]


@pytest.fixture(scope="module")
def with_table():
    return Scorer(TERMS)


@pytest.mark.parametrize(
    ("text", "category"),
    [
        ("you filthy slut", "sexual"), ("you stupid whore", "sexual"), ("suck my cock", "sexual"), ("you little blick", "sexual"), ("we will kill you all", "threat"), ("you piece of shit", "insult"), ("you dirty rotten blorf", "insult"),
        ("you are an idoit", "insult"), ("أنت غبي", "insult"), ("du bist ein Trottel", "insult"), ("tu es un abruti", "insult"), ("ты дебил", "insult"), ("お前はアホだ", "insult"),
    ],
)
def test_terms_of_all_categories(with_table, text, category):
    score, kind = with_table.score(text)
    assert (score >= FLAG_FROM, kind) == (True, category)


@pytest.mark.parametrize("text", ["You can kill the process if you want.", "The cock of the marshes is common.", "du rat des champs", "Die Stadt, die du siehst, ist alt.", "The study lists \"you filthy slut\" among insults recorded by courts.", "You may die of cold."])
def test_terms_in_harmless_use(with_table, text):
    assert with_table.score(text)[0] < FLAG_FROM


def test_recall_of_wordings():
    from wordings import CLEAN, EARLIER, LATER

    scorer = Scorer(TERMS)
    listed = lambda texts: sum(scorer.score(t)[0] >= FLAG_FROM for t in texts)
    assert listed(t for texts in EARLIER.values() for t in texts) >= 40
    assert all(listed(texts) for texts in EARLIER.values())
    assert listed(t for texts in LATER.values() for t in texts) >= 8
    assert listed(CLEAN) == 0


@pytest.mark.parametrize("text", ["f*ck you", "you piece of sh*t", "you filthy b*tch", "you stupid c*nt", "you filthy p*g", "you ugly a*s", "*fuck you", "*you filthy idiot", "**you filthy idiot**", "*f*ck you"])
def test_single_stars_and_list_marks(scorer, text):
    assert scorer.score(text)[0] >= FLAG_FROM


@pytest.mark.parametrize("text", ["2*you", "a*b = c*d", "*you* are kind", "* You may add a *bold* word."])
def test_stars_of_harmless_texts(scorer, text):
    assert scorer.score(text)[0] < FLAG_FROM


@pytest.mark.parametrize("text", ["[[User:You_filthy_idiot]]", "you filthy _idiot_", "fuck_you", "| known_for = you_stupid_pig", "[[File:Vorta_is_a_filthy_moron.jpg]] you"])
def test_words_joined_by_underscores(scorer, text):
    assert scorer.score(text)[0] >= FLAG_FROM


@pytest.mark.parametrize("text", ["You! Filthy idiot", "you filthy i d ! o t", "you stupid p ! g s", "he smells like s h ! t"])
def test_exclamation_marks_end_nothing(scorer, text):
    assert scorer.score(text)[0] >= FLAG_FROM


def test_stretches_are_the_text():
    from weftline.llm.stretches import stretches

    text = "One! Two. Three?\r\nFour!\n\nFive\rSix"
    assert "".join(stretches(text)) == "".join(stretches(text, after_exclamation=False)) == text
    assert stretches(text, after_exclamation=False) == ["One! Two.", " Three?", "\r\nFour!", "\n\nFive\rSix"]


@pytest.mark.parametrize("text", ["suck my dcik", "you ugly dcik", "you filthy jrek"])
def test_middle_letters_swapped(scorer, text):
    assert scorer.score(text)[0] >= FLAG_FROM


def test_swaps_in_words_of_four():
    trie = LexiconTrie(["dick", "jerk", "zorn"])
    for word in trie.words:
        for i in range(3):
            assert [trie.words[k] for k in trie.near(word[:i] + word[i + 1] + word[i] + word[i + 2 :], 1)] == [word]


@pytest.mark.parametrize("text", ["Vortaは死\u200bね", "Vortaは馬<!-- -->鹿だ、死<!-- -->ね", "Vortaはﾀﾋね", "Vortaは死・ね", "Vortaは氏ね", "ｸｽﾞ野郎", "お前はｱﾎだ"])
def test_disguised_strings_without_spaces(scorer, text):
    assert scorer.score(text)[0] >= FLAG_FROM


@pytest.mark.parametrize("text", ["馬鹿野郎という言葉の語源を研究した。", "彼は昆虫だから害はない。", "町は川の沿岸にある。"])
def test_harmless_texts_without_spaces(scorer, text):
    assert scorer.score(text)[0] < FLAG_FROM
