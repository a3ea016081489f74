"""Prefixes told without patterns, and with them where a path has a backslash or a key that begins with a bracket."""

from plumbline.operators import records as RC


def test_plain_and_escaped_paths(spark):
    paths = ["$['w']['A'][3]['x']['Y']", "$[0]['w'][1]['A']['x'][2]", "$['w']['x['][0]['y[']", "$['w'][']A']['n']", "$['w']['a\\'b'][7]['c\\'d']", "$['v']['A']['x']", "$['w']", "$", "$['w']['A']"]
    leaves = spark.createDataFrame([(1, i, p, "t") for i, p in enumerate(paths)], "k long, ordinal long, path string, text string")
    got = {r.ordinal: (r.prefix, r.wildcard, r.rest, r.name, r.below) for r in RC.placed(leaves, "k", [("works", "w.*")]).collect()}
    assert got == {
        0: ("$['w']['A'][3]", "A", "['x']['Y']", "y", 2),
        1: ("$[0]['w'][1]['A']", "A", "['x'][2]", None, 1),
        2: ("$['w']['x['][0]", "x[", "['y[']", "y[", 1),
        3: ("$['w'][']A']", "]A", "['n']", "n", 1),
        4: ("$['w']['a\\'b'][7]", "a'b", "['c\\'d']", "c'd", 1),
        8: ("$['w']['A']", "A", "", "a", 0),
    }
