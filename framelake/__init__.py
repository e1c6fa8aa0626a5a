"""framelake: Spark-native analytics over particle trajectories, profiles and tables."""

__version__ = "0.1.0"
