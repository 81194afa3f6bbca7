from helpers import values

from packloom.operators.ignore import ignore_files, ignored_entries
from packloom.operators.tree import with_directories


def ignored(table):
    return values(ignored_entries(with_directories(table), ignore_files(table)), "rel_path")


def test_negation_directories_and_depth(entries):
    files = {
        ".gitignore": "*.log\n!keep.log\nbuild/\n/top\n# note\n\nlib/**/gen\n\\!odd\ntrail   \n",
        "a.log": "", "sub/b.log": "", "sub/keep.log": "", "build/x.txt": "", "src/build": "", "top": "", "sub/top": "",
        "lib/gen": "", "lib/a/b/gen/x": "", "!odd": "", "sub/trail": "",
        "sub/.gitignore": "!b.log\nlocal.txt\n", "sub/local.txt": "", "local.txt": "", "sub/deep/local.txt": "",
    }
    assert ignored(entries(files)) == {
        "a.log", "build", "build/x.txt", "top", "lib/gen", "lib/a/b/gen", "lib/a/b/gen/x", "!odd", "sub/trail",
        "sub/local.txt", "sub/deep/local.txt"}


def test_a_pruned_directory_cannot_be_reentered(entries):
    files = {".gitignore": "build/\n!build/keep.txt\n", "build/keep.txt": "", "build/.gitignore": "!keep.txt\n"}
    assert ignored(entries(files)) == {"build", "build/keep.txt", "build/.gitignore"}


def test_contents_ignored_but_one_kept(entries):
    files = {".gitignore": "build/*\n!build/keep.txt\n", "build/keep.txt": "", "build/x": ""}
    assert ignored(entries(files)) == {"build/x"}


def test_dot_ignore_beats_gitignore_at_any_depth_and_both_beat_the_exclude_file(entries):
    files = {".ignore": "!a.txt\nb.txt\n", "sub/.gitignore": "a.txt\n!b.txt\n!c.txt\n", ".git/info/exclude": "c.txt\nd.txt\n",
             "sub/a.txt": "", "sub/b.txt": "", "sub/c.txt": "", "sub/d.txt": ""}
    assert ignored(entries(files)) == {"sub/b.txt", "sub/d.txt"}


def test_rules_do_not_reach_into_inner_repositories(entries):
    files = {".gitignore": "*.log\n", ".ignore": "*.tmp\n", "inner/.git/config": "", "inner/a.log": "", "inner/a.tmp": "",
             "inner/sub/b.log": "", "outer/c.log": ""}
    assert ignored(entries(files)) == {"outer/c.log", "inner/a.tmp"}


def test_malformed_lines_are_skipped_and_projects_do_not_mix(entries):
    one = entries({".gitignore": "[\n*.x\n{a\n", "a.x": "", "b.y": ""}, "one")
    two = entries({".gitignore": "*.y\n", "a.x": "", "b.y": ""}, "two")
    both = one.unionByName(two)
    got = ignored_entries(with_directories(both), ignore_files(both))
    assert values(got, "project", "rel_path") == {("one", "a.x"), ("two", "b.y")}


def test_windows_line_ends_and_byte_order_mark(entries):
    assert ignored(entries({".gitignore": "﻿a.txt\r\nb.txt\r\n", "a.txt": "", "b.txt": "", "c.txt": ""})) == {"a.txt", "b.txt"}


def test_many_rules_in_one_file(entries):
    files = {".gitignore": "".join(f"f{i}.txt\n" for i in range(0, 600, 2)), **{f"d/f{i}.txt": "" for i in range(600)}}
    assert ignored(entries(files)) == {f"d/f{i}.txt" for i in range(0, 600, 2)}
