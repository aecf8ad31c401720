import pytest
from cases import edge_docs, rows_of, sf_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from tarmac.llm import tokcount
from tarmac.llm.words import default_vocab, load_tokenizer

TOK = load_tokenizer(default_vocab())
VOCAB = {tokcount.symbols(t) for t in TOK.get_vocab() if not t.startswith("<|")}
LONGEST = max(map(len, VOCAB))


def greedy(word, vocab=VOCAB, longest=LONGEST):
    """Number of greedy longest-match tokens, None without a cut."""
    at = n = 0
    while at < len(word):
        for to in range(min(len(word), at + longest), at, -1):
            if tuple(word[at:to]) in vocab:
                break
        else:
            return None
        at, n = to, n + 1
    return n


def plain_counts(text):
    words = [w for w, _ in TOK.pre_tokenizer.pre_tokenize_str(TOK.normalizer.normalize_str(text or ""))]
    return len(words), sum(1 if (n := greedy(tokcount.symbols(w + "</w>"))) is None else n for w in words)


@pytest.mark.parametrize("make", [sf_docs, edge_docs])
def test_counts_match_brute_force(spark, make):
    docs = make(spark)
    got = sorted(rows_of(tokcount.token_counts(docs)), key=repr)
    assert got == sorted(((r.doc_id, *plain_counts(r.text)) for r in docs.collect()), key=repr)


def test_empty_table(spark):
    assert rows_of(tokcount.token_counts(edge_docs(spark, []))) == []


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12), st.text("abcd", max_size=25))
def test_automaton_equals_greedy(tokens, word):
    got = tokcount.Automaton(tuple(t) for t in sorted(tokens)).count(word)
    assert got == greedy(word, {tuple(t) for t in tokens}, 5)
