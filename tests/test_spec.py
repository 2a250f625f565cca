import pytest

from fityard.spec import DATASETS, DatasetSpec


def test_known_datasets():
    assert DATASETS["susy"].columns == ["target"] + [str(i) for i in range(18)]
    assert len(DATASETS["cats_dogs"].struct()) == 2049


def test_target_may_stand_anywhere():
    assert DatasetSpec("x", 3, target_col_idx=2).columns == ["0", "1", "target", "2"]
    assert DatasetSpec("x", 2, target_col_idx=2).columns == ["0", "1", "target"]


@pytest.mark.parametrize("kwargs", [{"num_cols": 0}, {"num_cols": 2, "target_col_idx": 3},
                                    {"num_cols": 2, "chunk_rows": 0}])
def test_bad_specs(kwargs):
    with pytest.raises(ValueError):
        DatasetSpec("x", **kwargs)
