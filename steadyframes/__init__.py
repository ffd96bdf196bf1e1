"""Spark jobs for motion estimation and stabilization over collections of frames."""
