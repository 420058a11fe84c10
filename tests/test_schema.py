import pytest

from tidemark.lifecycle import can_upgrade
from tidemark.schema import DType, FeatureField, FeatureSchema

F32, I32, I64, F64, U8 = DType.FLOAT32, DType.INT32, DType.INT64, DType.FLOAT64, DType.UINT8


def s(version=1, *fields, name="S"):
    return FeatureSchema(name, version, list(fields) or [FeatureField("x", F32)])


def test_names_versions_and_fields_are_checked():
    for bad in ("", "1a", "a-b", "x" * 64):
        with pytest.raises(ValueError):
            s(name=bad)
    with pytest.raises(TypeError):
        FeatureSchema("S", True, [FeatureField("x", F32)])
    with pytest.raises(ValueError):
        FeatureSchema("S", 1, [])
    with pytest.raises(ValueError):
        s(1, FeatureField("x", F32), FeatureField("x", F64))
    for shape in ((0,), (-1,), (True,), [3]):
        with pytest.raises(ValueError):
            FeatureField("x", F32, shape)
    with pytest.raises(ValueError):
        FeatureField("x", F32, (1 << 25,))
    with pytest.raises(ValueError):
        s(1, FeatureField("entity_id", F32)).log_type()


def test_rank_three_may_be_declared_but_has_no_column():
    f = FeatureField("x", F32, (2, 2, 2))
    with pytest.raises(ValueError):
        f.spark_type


def test_json_and_fingerprint():
    a = s(1, FeatureField("a", F32), FeatureField("m", U8, (2, 3)))
    assert FeatureSchema.from_json(a.to_json()) == a
    b = s(1, FeatureField("m", U8, (2, 3)), FeatureField("a", F32))
    assert a.fingerprint() != b.fingerprint()
    assert (a.n_elements, a.row_bytes(), a.row_bytes(padded=False)) == (7, 128, 10)


def test_can_upgrade_collects_every_reason():
    old = s(2, FeatureField("a", F32), FeatureField("b", I32), FeatureField("m", F32, (2, 2)), FeatureField("v", F32, (3,)))
    new = s(2, FeatureField("a", I64), FeatureField("m", F32, (2, 2)), FeatureField("v", F32, (4,)), FeatureField("n", F32, (2, 2)))
    ok, why = can_upgrade(old, new)
    assert not ok and len(why) == 6
    assert can_upgrade(s(1, FeatureField("a", F32), FeatureField("u", U8)), s(2, FeatureField("u", I64), FeatureField("a", F64), FeatureField("n", F32, (3,)))) == (True, [])
