"""Tables of a row per segment or point do not go through the driver."""

from tripmill.operators import motion, noise
from tripmill.plans import fixtures as fx
from tripmill.plans.motion_profile import segments_of
from tripmill.session import stage


def test_noise_sweep_without_broadcasts(spark):
    clean = motion.clean_segments(segments_of(fx.points(spark, "/root/testdata/sf0.001")))
    segments = stage(clean, "clean")
    swept = noise.noise_sweep(segments)
    assert swept.select("noise_config").distinct().count() == 16
    for df in (clean, swept):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().simpleString()
