from tallyline.sinks import csv_files, file_tree

__all__ = ["csv_files", "file_tree"]
