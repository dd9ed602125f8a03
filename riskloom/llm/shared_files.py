"""Arrays in files of the shared folder; see riskloom.shared_files."""

from riskloom.shared_files import joined, open_arrays, place, write_arrays  # noqa: F401
