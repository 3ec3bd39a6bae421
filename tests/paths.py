"""Places of the driver's small tables."""

SF0001 = "/root/testdata/sf0.001"
