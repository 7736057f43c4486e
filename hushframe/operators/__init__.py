"""Operators over DataFrames: detection, masking, chats, layout, tracks, time series, audits."""
