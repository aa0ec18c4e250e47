"""Behavioural threat-intelligence jobs on Spark DataFrames."""
