import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import expansions as X
from driftline.functions import vectors as V
from driftline.sources import files, synthetic


def test_feature_files(spark, tmp_path):
    x = np.arange(12.0).reshape(4, 3)
    (tmp_path / "a.bin").write_bytes(files.feature_blob(x, 5))
    rows = files.read_features(spark, str(tmp_path / "a.bin")).orderBy("row").collect()
    assert [r["features"] for r in rows] == x.tolist()
    head = files.feature_headers(spark, str(tmp_path / "a.bin")).first()
    assert (head["iteration"], head["rows"], head["size"]) == (5, 4, 3)
    with pytest.raises(ValueError):
        files.feature_matrix(b"\0" * 32)


def test_raw_and_idx_files(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(bytes(range(6)))
    rows = files.read_raw(spark, str(tmp_path / "a.raw"), 3).orderBy("row").collect()
    assert np.allclose([r["features"] for r in rows], np.arange(6).reshape(2, 3) / 255)
    images = np.arange(8, dtype=np.uint8)
    (tmp_path / "i").write_bytes(bytes([0, 0, 8, 3]) + np.array([2, 2, 2], ">u4").tobytes() + images.tobytes())
    (tmp_path / "l").write_bytes(bytes([0, 0, 9, 1]) + np.array([2], ">u4").tobytes() + bytes([7, 3]))
    rows = files.read_idx(spark, str(tmp_path / "i"), str(tmp_path / "l"), [3]).collect()
    assert [(r["class"], r["features"]) for r in rows] == [(3, [4.0, 5.0, 6.0, 7.0])]


def test_text_sources_and_sinks(spark, tmp_path):
    (tmp_path / "f.txt").write_text("1.5\n2.5\n")
    assert files.read_text_features(spark, str(tmp_path / "f.txt")).first()["features"] == [1.5, 2.5]
    (tmp_path / "a.csv").write_text("Filename;Width;Height;X1;Y1;X2;Y2;ClassId\na.png;5;6;1;2;3;4;9\n")
    assert files.read_annotations(spark, str(tmp_path / "a.csv")).first()["ClassId"] == 9
    rows = spark.createDataFrame([(1, [0.5, 0.0])], "label int, features array<double>")
    files.write_libsvm(rows, str(tmp_path / "svm"))
    assert spark.read.text(str(tmp_path / "svm")).first()[0] == "1 1:0.5 2:0.0"
    files.write_chunks(spark.range(10).coalesce(1), str(tmp_path / "chunks"), 4)
    assert len(list((tmp_path / "chunks").glob("*.parquet"))) == 3
    assert files.list_files(spark, str(tmp_path), "*.csv").first()["length"] > 0


def test_synthetic_sources(spark):
    rows = synthetic.dataset(spark, "random_latent", 100, 5, 3)
    assert sorted(map(str, rows.collect())) == sorted(map(str, synthetic.random_latent(spark, 100, 5, 3).repartition(7).collect()))
    assert synthetic.random_subset(rows, 10).count() == 10
    with pytest.raises(ValueError):
        synthetic.random_subset(rows, 101)
    with pytest.raises(ValueError):
        synthetic.dataset(spark, "none such")
    assert synthetic.repeated(rows, 3).count() == 300
    assert synthetic.fingerprint(rows).first() == synthetic.fingerprint(rows.repartition(5)).first()
    assert {r["split"] for r in synthetic.splits(rows).collect()} == {"train", "supervised", "test"}


def one(spark, column):
    return spark.range(1).select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("name", "size", "count"),
    [("identity", 5, 5), ("QT", 5, 15), ("CT", 4, 20), ("P4", 3, 15), ("P5", 3, 21), ("u08", 5, 5), ("s15_p1", 5, 5), ("sel3_QT", 5, 6), ("div2_sel2_u08", 6, 4), ("ch3_o1_s1_QT", 6, 6), ("QT_3_AP08", 5, 6), ("C_AE_exp", 3, 3 + 6 + 10), ("Q_E", 3, 6), ("cos3_v2", 3, 9), ("control2_QT", 4, 6), ("product_adj3", 5, 9), ("max_mix2", 5, 6), ("median3", 5, 3), ("neighbour_sign", 5, 4), ("pair_abs_sum", 3, 9), ("smart_cos", 8, 8 + 8 + 36 + 120), ("signed_04_adj2", 4, 6)],
)
def test_expansions_have_their_sizes(spark, name, size, count):
    x = F.array(*[F.lit(v) for v in np.linspace(-1, 1.3, size).tolist()])
    assert len(one(spark, X.expand(x, size, name))) == count


def test_expansion_errors(spark):
    with pytest.raises(ValueError):
        X.expansion("nothing_like_it")
    with pytest.raises(ValueError):
        X.expand(F.array(F.lit(1.0), F.lit(2.0)), 2, "ch2_o1_s4_QT")


def test_vector_functions(spark):
    x = F.array(*[F.lit(v) for v in (1.0, -2.0, 0.5)])
    order = V.permutation(3, 1)
    assert one(spark, V.gather(V.gather(x, order), V.permutation_inverse(order))) == [1.0, -2.0, 0.5]
    assert np.allclose(one(spark, V.soft_clip_inverse(V.soft_clip(x, 4.0), 4.0)), [1.0, -2.0, 0.5])
    assert one(spark, V.increasing(x)) is False and one(spark, V.increasing(F.array(F.lit(1.0), F.lit(2.0)))) is True
    assert one(spark, V.written(x, 2)) == "1.00, -2.00, 0.50"
    assert one(spark, V.distance(x, F.transform(x, lambda v: v + 2))) == pytest.approx(np.sqrt(12))
    assert one(spark, V.scale_to(F.lit(5.0), 0, 10, -1, 1)) == 0 and one(spark, V.scale_to(F.lit(10.0), 0, 10, -1, 1, True)) == pytest.approx(1)
    assert one(spark, V.tile(x, 2)) == [1.0, -2.0, 0.5] * 2 and one(spark, V.skip(x, 2)) == [0.5]
    assert V.monomials(5, 2) == 15 and one(spark, V.hamming_weight(F.lit(7))) == 3
