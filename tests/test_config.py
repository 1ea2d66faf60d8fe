import pytest

from tidemark.config import DAY, SECOND, Mode, RollupConfig, grid_ceil, interval_begin, interval_end


def test_defaults_and_levels():
    c = RollupConfig()
    assert (c.interval_min, c.interval_max, c.interval_factor) == (10 * SECOND, 365 * DAY, 10)
    assert RollupConfig(14_400_000_000_000, 1_440_000_000_000_000, 10).levels == [14_400_000_000_000, 144_000_000_000_000, 1_440_000_000_000_000]
    assert RollupConfig(1_337_000_028, 1 << 60, 42).interval_factor == 42


@pytest.mark.parametrize("args", [(10, 100, 3), (0, 10, 2), (10, 5, 2), (10, 100, 1), (-10, 10, 2)])
def test_rejects(args):
    with pytest.raises(ValueError):
        RollupConfig(*args)


def test_overflow():
    with pytest.raises(OverflowError):
        RollupConfig(10, 1 << 63, 10)
    with pytest.raises(ValueError):
        RollupConfig(10, 100, 10).divide(15)


def test_grid():
    assert (interval_begin(25, 10), interval_end(25, 10), interval_end(20, 10)) == (20, 30, 30)
    assert (grid_ceil(20, 10), grid_ceil(21, 10)) == (20, 30)
    with pytest.raises(ValueError):
        interval_begin(-1, 10)


def test_level_choice():
    c = RollupConfig(10, 1000, 10)
    assert [c.level_for(x) for x in (9, 10, 99, 100, 5000)] == [None, 10, 10, 100, 1000]


def test_modes():
    assert Mode("R").reads and not Mode("R").writes and not Mode("W").reads and Mode("RW").writes
