"""The registered queries over the test tables, and their SQL counterparts."""

from __future__ import annotations


def all_books():
    from samplewright.plans import diffs, files, graph, qa, trees

    return [qa.book, diffs.book, graph.book, trees.book, files.book]
