"""Spark library for panels of short ordered sequences.

Every public operator takes and returns DataFrames. A panel is keyed by
(group_id, seed, recording_id, time_index); time is an integer index that
starts at 0 in each sequence.
"""

GROUP, SEED, RECORDING, TIME = "group_id", "seed", "recording_id", "time_index"
SEQUENCE = (GROUP, SEED, RECORDING)
EPS = 1e-12
