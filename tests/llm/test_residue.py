"""Residue: texts of no visible table, decoys, recurrence, structure and defined cases."""

import pytest

from forgelens.llm import residue

UNSEEN = [
    "Error 521: the web server is down", "Hello %(username)s, thanks", "Welcome to |COMPANY|", "Veuillez autoriser les scripts", "The requested URL was not found on this server.",
    "This site can’t be reached", "Application error: a client-side exception has occurred", "Please turn JavaScript on and reload the page.", "Ihre Sitzung ist abgelaufen.", "ページを表示できません",
    "Dear [First Name],", "Name: ________", "Your browser does not support JavaScript", "ERROR: The request could not be satisfied", "Deze pagina is niet gevonden",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore", "504 Gateway Time-out nginx", '{"error": {"code": 503, "message": "Service Unavailable"}}',
    "<Error><Code>NoSuchBucket</Code><Message>gone</Message></Error>", "test test test test", "asdf qwer asdf foo bar", "Welcome *|FNAME|*", "TBD", "Accès refusé",
]
ORDINARY = [
    "When the tracker answers 404 Not Found for a recipe, the client now stops at once.", "Access was denied to the build user on motor; adding it to the group solved it.",
    "Without scripts the dashboard still lists every path; only sorting needs JavaScript.", "feat: add not found page", "You need to enable the plugin first.", "This function returns null",
    'The docs mention "Page not found" twice.', "Use `{{ name }}` in the text", "> 404 Not Found", "```\nError 500\n```", "The build is [WIP]", "| A | B |\n|---|---|", "if x_{i} = {1, 2}", "Every commit in common replaces the other.",
]


@pytest.mark.parametrize("text", UNSEEN)
def test_unseen_residue_is_found(text):
    assert any(sure for _, _, sure, _ in residue.found_in(text)), text


@pytest.mark.parametrize("text", ORDINARY)
def test_talk_about_residue_is_not(text):
    assert not any(sure for _, _, sure, _ in residue.found_in(text)), text


def test_indented_lines_are_code_only_after_a_blank_line():
    assert residue.found_in("- item\n    Dear {{ name }}")
    assert not residue.found_in("Example:\n\n    Dear {{ name }}\n\nend")
    assert residue.found_in("    Dear {{ name }}")


def test_a_weak_phrase_needs_company_or_recurrence(spark):
    rows = [(1, "Your lease has expired.", "a"), (2, "The day was long.\n\nYour lease has expired.", "a")]
    df = lambda r: spark.createDataFrame(r, "doc_id long, text string, source string")
    assert [r.doc_id for r in residue.residue(df(rows)).collect()] == [1]
    more = rows + [(3, "A word.\n\nYour lease has expired.", "b"), (4, "Another.\n\nYour lease has expired.", "b"), (4, "Another.\n\nYour lease has expired.", "b")]
    assert sorted(r.doc_id for r in residue.residue(df(more)).collect()) == [1, 2, 3, 4]
    one_source = [(i, t, "a") for i, t, _ in more]
    assert [r.doc_id for r in residue.residue(df(one_source)).collect()] == [1]


def test_messages_count_documents_and_sources_of_the_masked_form(spark):
    rows = [(i, f"Error {500 + i % 2}. Incident {i}", "abc"[i % 3]) for i in range(9)] + [(None, None, None), (11, "", "a"), (12, "   ", None)]
    found = {r.norm: (r.documents, r.sources) for r in residue.recurrence(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found == {"error #.": (9, 3)} or found == {"error #. incident #": (9, 3)}


def test_long_texts_are_read_to_their_end(spark):
    text = "A plain sentence about nothing. " * 20_000 + "\n\n404 Not Found"
    assert residue.residue(spark.createDataFrame([(1, text, "a", "x")], "doc_id long, text string, source string, norm string")).count() == 1
