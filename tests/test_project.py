"""Project files as typed settings."""

from __future__ import annotations

import pytest

from variantlab.sources.settings import Project, project


def test_defaults():
    assert project("") == Project() and Project().folds == 4 and Project().trees == 382


def test_values_have_their_types():
    got = project(
        "Path_to_dataset_file = data/a.tsv  # samples\ncrossValidation = 7\nsplit_rate=0.3\nprot_based_separation = True\n"
        "tag_filter = a, b,\nbalanceSubsampling = None\ntarget_map = low:0, high:1\ntarget_values = 0, 0.5\noutfolder =\nnew_key = x\nnum_of_trees = 9\n",
        "num_of_trees 12\ncorr_thresh = 0.75\nearly_stopping 5\n",
    )
    assert (got.samples, got.folds, got.split_rate, got.by_protein, got.tag_filter) == ("data/a.tsv", 7, 0.3, True, ("a", "b"))
    assert (got.balance, got.target_map, got.target_values, got.outfolder) == (None, {"low": "0", "high": "1"}, (0.0, 0.5), None)
    assert (got.trees, got.corr_thresh, got.early_stopping, got.other) == (12, 0.75, 5, {"new_key": "x"})


@pytest.mark.parametrize("line", ["skip_cv = yes", "crossValidation = many", "split_rate = a"])
def test_a_wrong_value_names_its_key(line):
    with pytest.raises(ValueError, match=line.split()[0]):
        project(line)


def test_projects_share_nothing():
    project("a = 1").target_map["x"] = "y"
    assert project("").target_map == {}
