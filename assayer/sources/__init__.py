"""Readers and writers of run logs, reports, file trees and bundles."""
