"""NEXUS files by their tokens: any label survives quoting, comments nest, broken texts say so."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladewise.sources import nexus, profile_files, trees

LABEL = st.text(alphabet="ab'\"[](){};,:= \n&_é-", min_size=1, max_size=9)


def quoted(label):
    return "'" + label.replace("'", "''") + "'"


@settings(max_examples=150, deadline=None)
@given(st.lists(LABEL, min_size=2, max_size=5, unique=True), LABEL, st.booleans())
def test_labels_survive(labels, name, translated):
    shown = [str(i) for i in range(len(labels))] if translated else [quoted(x) for x in labels]
    table = "translate " + ", ".join(f"{i} {quoted(x)}" for i, x in enumerate(labels)) + ";" if translated else ""
    text = f"#NEXUS [a [b] 'c] begin taxa; taxlabels {' '.join(map(quoted, labels))}; end; begin trees; {table} tree {quoted(name)} = [&U] [&lnP=-1] ({','.join(f'{x}:{i}' for i, x in enumerate(shown))}); endblock;"
    found = nexus.parse(text)
    assert found.taxa == labels
    (tree,) = found.trees
    assert (tree.name, tree.default, tree.rooted) == (name, False, False)
    assert [(r[2], r[3]) for r in tree.rows if not r[5]] == [(x, float(i)) for i, x in enumerate(labels)]


def test_annotations():
    assert nexus.notes('&!name="a, b",k={1,2},[c=d],e=\'f\',rate=0.5,&x={}') == {"name": ["a, b"], "k": ["1", "2"], "e": ["f"], "rate": ["0.5"], "[c": ["d]"], "&x": [""]}
    assert nexus.notes("plain") == nexus.notes("&") == nexus.notes("") == {}
    rows = trees.parse_newick("(a[&x={1,[2]},y=3]:1,b:2)")
    assert rows[1][6] == {"x": ["1", "[2]"], "y": ["3"]}
    # In Newick alone = and ] are letters, and so is a quote that isn't closed.
    assert [r[2] for r in trees.parse_newick("(a=1:2,b]:3,'c:4)") if r[2]] == ["a=1", "b]", "'c"]


def test_several_trees_and_numbers():
    text = "#nexus\nBEGIN data; matrix a 01; end;\nbegin taxa;\ndimensions ntax=3; taxlabels one 'two 2' 3; end;\nbegin trees;\ntree * first = [&R] (1,(2,3)[&p=1]);\nutree *second=(1,2);\nend;"
    first, second = nexus.parse(text).trees
    assert (first.name, first.default, first.rooted, second.name, second.default, second.rooted) == ("first", True, True, "second", True, None)
    # A number that is itself a label stays.
    assert [r[2] for r in first.rows if not r[5]] == ["one", "two 2", "3"]
    assert [r[2] for r in trees.parse_nexus(text) if not r[5]] == ["one", "two 2", "3"]


@pytest.mark.parametrize(("text", "wrong"), [
    ("#NEXUS begin trees; tree t = (a,'b);", "a quote is not closed"), ("#NEXUS [a [b]", "a comment is not closed"), ("#NEXUS begin trees; tree t = (a,b;", "a bracket is not closed"), ("#NEXUS ] x;", "that none opened"),
    ("#NEXUS begin trees; tree (a,b);", "without ="), ("#NEXUS begin trees; translate 1 a b, 2 c; tree t=(1,2);", "translates nothing"), ("#NEXUS begin trees; tree t = (a=b);", "within a tree"),
])
def test_what_is_wrong(spark, text, wrong):
    with pytest.raises(ValueError, match=wrong):
        nexus.parse(text)
    rows = nexus.nexus_trees(spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "#NEXUS begin trees; tree t=(a,b); end;", "x")], "tree_id int, text string, error string")).collect()
    assert [r["tree_id"] for r in rows if r["error"]] == [1] and wrong in rows[0]["error"]
    assert sorted(r["name"] for r in rows if r["tree_id"] == 4 and r["name"]) == ["a", "b"]
    assert {r["tree_id"] for r in rows} == {1, 4}


@pytest.mark.parametrize("text", [">a\nAC", "#Strain\tL1", "#NEXUS\n", "#nexus x", "ID,Year\n1,2", "(a,b);", " a,b", "{,", "[,", "a\tb", "", "x", "a\n,"])
def test_formats_as_a_column(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(profile_files.format_of(df["t"])).first()[0] == profile_files.detect_format(text)
