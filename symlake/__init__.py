"""symlake: structural analysis of source trees and text corpora on PySpark."""
