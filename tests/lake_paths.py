"""Folders of the driver's tables, in a module of its own name."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
