"""Part of the voxfield engine; see README.md."""
