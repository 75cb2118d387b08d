"""Relational operators over timetables, roads, places and itineraries: DataFrames in, DataFrames out."""
